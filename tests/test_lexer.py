import pytest

from simloom.functions.tokens import IGNORED_WORDS, token_allowed
from simloom.sources.lexer import find_blocks

BODY = "alpha = beta;\n" * 6

CASES = {
    "c": ("int work_it(int alpha, int beta) {\n%s}\n", "work_it"),
    "cpp": ("template <class T> T Foo<T>::work_it(T alpha) const {\n%s}\n", "work_it"),
    "go": ("func (s *Srv) work_it(alpha int) error {\n%s}\n", "work_it"),
    "java": ("class K {\npublic int work_it(int alpha) throws Oops {\n%s}\n}\n", "work_it"),
    "javascript": ("function work_it(alpha) {\n%s}\n", "work_it"),
    "typescript": ("class K {\nwork_it(alpha: number): number {\n%s}\n}\n", "work_it"),
    "php": ("<?php\nfunction work_it($alpha) {\n%s}\n", "work_it"),
    "rust": ("pub fn work_it<'a>(alpha: &'a str) -> Beta {\n%s}\n", "work_it"),
}


@pytest.mark.parametrize("language", CASES)
def test_function_and_body(language):
    source, name = CASES[language]
    found = find_blocks(source % BODY, language)
    assert [b.kind for b in found] == ["function", "block"]
    assert name in found[0].tokens and name not in found[1].tokens
    assert found[1].end_line - found[1].start_line == 7


def test_gates():
    block = lambda n: "void run_it() {\n if (go_on) {\n" + "step_a(step_b);\n" * n + "}\n}\n"
    kinds = lambda n: [(b.kind, b.end_line - b.start_line) for b in find_blocks(block(n), "c")]
    assert ("block", 5) in kinds(4) and ("block", 4) not in kinds(3)
    assert find_blocks("int one_line(int aa) { return bb; }", "c")[0].kind == "function"
    assert find_blocks("int aa() { return bb; }", "c") == []  # two tokens
    assert find_blocks("anything {", "cobol") == []


def test_nested_blocks_all_come():
    source = "void outer_fn() {\n while (go_on) {\n" + "step();\n" * 5 + "}\n}\n"
    assert [b.kind for b in find_blocks(source, "c")] == ["function", "block", "block"]


def test_tokens():
    text = 'void fnname() { call_one("string_lit", 12345, \'c\'); /* note_a */ x = call_two; // note_b\n}'
    assert find_blocks(text, "cpp")[0].tokens == ("fnname", "call_one", "call_two")
    assert token_allowed("ö") and not token_allowed("x") and not token_allowed("42")
    assert not any(token_allowed(w) for w in IGNORED_WORDS)
    rust = find_blocks("fn go_on() { std::mem::swap(aa, bb); }", "rust")[0].tokens
    assert rust == ("go_on", "std::mem::swap", "std::mem", "std", "mem", "swap", "aa", "bb")


def test_preprocessor():
    text = "int work_it() {\n#if FLAG_A\n skipped_one();\n#endif\n#ifdef FLAG_B\n kept_one();\n#else\n skipped_two();\n#endif\n done();\n}\n"
    assert find_blocks(text, "c")[0].tokens == ("work_it", "FLAG_B", "kept_one", "done")


def test_what_is_no_block():
    assert find_blocks("struct foo { int aa; int bb; int cc; };\nint arr[] = { one_a, two_b, three_c };\n", "c") == []
    js = "const table = {\n" + "key_a: value_b,\n" * 8 + "};\nswitch (mode_a) {\n" + "case one_b: go_on();\n" * 8 + "}\n"
    assert find_blocks(js, "javascript") == []
    arrow = find_blocks("list.map((item, place) => { return item.value + place; });", "javascript")
    assert [b.tokens for b in arrow] == [("item", "place", "item", "value", "place")]
    assert find_blocks("const re = /a{2}/; const t = `x${name_a}`; function ff() { aa(bb); }", "javascript")[0].tokens == ("ff", "aa", "bb")
