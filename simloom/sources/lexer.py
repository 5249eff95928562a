"""A tolerant lexer and block finder for eight brace languages.

There is no grammar here: source text becomes tokens (comments, literals and
numbers go), braces are matched, and each opening brace is judged by the tokens
before it: the body of a function, a block of statements, or something else
(type bodies, initialisers, object literals, match and switch bodies).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from simloom.functions.tokens import token_allowed

#: A block of statements needs this many lines between its first and last one; functions none.
MIN_BLOCK_ROWS = 5

_C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool true false"
KEYWORDS = {
    "c": _C_WORDS,
    "cpp": _C_WORDS + " alignas alignof and catch class concept consteval constexpr const_cast co_await co_return co_yield decltype delete dynamic_cast explicit export final friend mutable namespace new noexcept not nullptr operator or override private protected public reinterpret_cast requires static_assert static_cast template this throw try typeid typename using virtual",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var true false nil",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "javascript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield true false null async of",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty extends final finally fn for foreach function global goto if implements include instanceof insteadof interface isset list match namespace new or print private protected public require return static switch throw trait try unset use var while xor yield true false null",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " abstract any as boolean declare enum implements interface is keyof namespace never number private protected public readonly string type undefined unknown"
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_NAME = r"[^\W\d]\w*"
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?"
_CHARS = r"'(?:\\.|[^'\\\n])*'?"
_NUMBER = r"\.?\d(?:[eEpP][+-]|[\w.'])*"
_SIGNS = r"::|=>|->|\+\+|--|&&|\|\||[-+*/%^&|!<>=]=|[^\w\s]"


def _lexer(skip: str, name: str = _NAME, signs: str = _SIGNS, number: str = _NUMBER) -> re.Pattern[str]:
    return re.compile(rf"(?P<skip>{skip})|(?P<name>{name})|(?P<number>{number})|(?P<sign>{signs})", re.S)


_C_LEXER = _lexer(rf"{_COMMENT}|(?:u8|[uUL])?R\"(?P<tag>[^(\s]*)\(.*?\)(?P=tag)\"|(?:u8|[uUL])?{_QUOTED}|(?:u8|[uUL])?{_CHARS}")
LEXERS = {
    "c": _C_LEXER,
    "cpp": _C_LEXER,
    "go": _lexer(rf"{_COMMENT}|`[^`]*`?|{_QUOTED}|{_CHARS}"),
    "java": _lexer(rf"{_COMMENT}|\"\"\".*?(?:\"\"\"|\Z)|{_QUOTED}|{_CHARS}", r"[^\W\d][\w$]*|\$[\w$]*"),
    "javascript": _lexer(rf"{_COMMENT}|{_QUOTED}|{_CHARS}", r"#?(?:[^\W\d]|\$)[\w$]*"),
    "rust": _lexer(rf"{_COMMENT}|b?r(?P<tag>#*)\".*?\"(?P=tag)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]*?|[^'\\\n])'|'{_NAME}", rf"(?:r#)?{_NAME}", number=r"\d(?:[eE][+-]|\w|\.(?=\d))*"),
}
LEXERS["php"] = _lexer(r"//[^\n]*|/\*.*?(?:\*/|\Z)|#(?!\[)[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|<<<[ \t]*(?P<quote>['\"]?)(?P<tag>\w+)(?P=quote)\n.*?\n\s*(?P=tag)\b", r"\$?[^\W\d]\w*")
LEXERS["typescript"] = LEXERS["javascript"]

_TEMPLATE = re.compile(r"`(?:\\.|[^`\\])*`?", re.S)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || == != + - * % < > return typeof case in of".split())
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w+)((?:\\\r?\n|[^\n])*)")


@dataclass(frozen=True)
class Token:
    text: str
    line: int
    is_name: bool
    skipped: int = 0  # open preprocessor conditions whose tokens do not count


@dataclass(frozen=True)
class Block:
    kind: str  # "function" or "block"
    start_line: int
    end_line: int
    tokens: tuple[str, ...]


def tokenize(text: str, language: str) -> list[Token]:
    """Names and signs with their lines."""
    lexer = LEXERS[language]
    out: list[Token] = []
    at, line, size = 0, 1, len(text)
    script = language in ("javascript", "typescript")
    preprocessed = language in ("c", "cpp")
    conditions: list[int] = []  # 1 for #if, 0 for #ifdef (its #else counts 1)
    fresh = True  # at the start of a line
    if language == "php":
        begin = re.search(r"<\?(php|=)?", text)
        if begin is None:
            return out
        line += text.count("\n", 0, begin.end())
        at = begin.end()
    while at < size:
        ch = text[at]
        if ch.isspace():
            if ch == "\n":
                line += 1
                fresh = True
            at += 1
            continue
        m = None
        if preprocessed and fresh and ch == "#" and (m := _DIRECTIVE.match(text, at)):
            word = m[1]
            if word in ("if", "ifdef", "ifndef"):
                conditions.append(int(word == "if"))
            elif word in ("else", "elif", "elifdef", "elifndef") and conditions:
                conditions[-1] = 1
            elif word == "endif" and conditions:
                conditions.pop()
            name = re.match(rf"\s*({_NAME})(\()?", m[2])
            if name and (word in ("ifdef", "ifndef") or word == "define" and name[2]):
                out.append(Token(name[1], line, True, sum(conditions)))
        elif script and ch == "`":
            m = _TEMPLATE.match(text, at)
            for inner in re.finditer(r"\$\{([^}]*)\}", m[0]):
                out += [Token(t.text, line + m[0].count("\n", 0, inner.start()), t.is_name) for t in tokenize(inner[1], language) if t.text not in "{}"]
        elif script and ch == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            pass
        elif language == "php" and text.startswith("?>", at):
            again = re.compile(r"<\?(php|=)?").search(text, at)
            stop = again.end() if again else size
            line += text.count("\n", at, stop)
            at = stop
            continue
        else:
            m = lexer.match(text, at)
            if m and m.lastgroup in ("name", "sign"):
                out.append(Token(m[0], line, m.lastgroup == "name", sum(conditions)))
        fresh = False
        stop = m.end() if m and m.end() > at else at + 1
        line += text.count("\n", at, stop)
        at = stop
    return out


def _partners(tokens: list[Token]) -> dict[int, int]:
    """Matching brackets, both ways; unmatched ones are left out."""
    opening, closing = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
    stack: list[int] = []
    out: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.text in opening and not t.is_name:
            stack.append(i)
        elif t.text in closing and not t.is_name:
            for k in range(len(stack) - 1, -1, -1):
                if opening[tokens[stack[k]].text] == t.text:
                    out[stack[k]], out[i] = i, stack[k]
                    del stack[k:]
                    break
    return out


class BlockFinder:
    """Judges the braces of one source."""

    def __init__(self, tokens: list[Token], language: str):
        self.tokens, self.language = tokens, language
        self.partner = _partners(tokens)
        self.keywords = KEYWORDS[language]

    def _header(self, brace: int) -> int:
        """Where the statement that leads to this brace begins."""
        i = brace - 1
        while i >= 0:
            t = self.tokens[i].text
            if t in (")", "]") and i in self.partner:
                i = self.partner[i] - 1
                continue
            if t in (";", "{", "}", "(", "[") or (t == "," and self.language != "rust") or (t == ":" and i and self.tokens[i - 1].text in ("public", "private", "protected", "default")):
                return i + 1
            i -= 1
        return 0

    def _words(self, start: int, stop: int) -> list[str]:
        """The tokens of a header without the insides of brackets."""
        out, i = [], start
        while i < stop:
            t = self.tokens[i].text
            out.append(t)
            if t in ("(", "[", "{") and i in self.partner and self.partner[i] < stop:
                i = self.partner[i]
                out.append(self.tokens[i].text)
            i += 1
        return out

    def judge(self, brace: int, inside: str) -> tuple[str, int]:
        """What a brace opens ("function", "block", "type", "other") and where it begins.

        ``inside`` is the kind of the brace around it ("" at the top).
        """
        start = self._header(brace)
        head = self._words(start, brace)
        return getattr(self, "_" + {"c": "c", "cpp": "c", "typescript": "script", "javascript": "script"}.get(self.language, self.language))(head, start, brace, inside)

    # Each returns (kind, first token of the node).

    def _c(self, head: list[str], start: int, brace: int, inside: str) -> tuple[str, int]:
        last = head[-1] if head else ""
        in_code = inside in ("function", "block")
        if not head:
            return ("block", brace) if in_code else ("other", brace)
        if last in ("else", "do", "try"):
            return "block", brace
        if last in ("=", ",", "return") or last == "]" and "(" not in head:
            return "other", brace
        first = [h for h in head if h not in ("static", "inline", "extern", "typedef", "const", "template", "constexpr")]
        if first and first[0] in ("if", "for", "while", "switch", "catch"):
            return "block", brace
        if "(" not in head:
            return ("type", start) if any(k in head for k in ("class", "struct", "union", "namespace", "enum", "extern")) else ("block", brace) if in_code and last == ")" else ("other", brace)
        if in_code:
            return ("block", brace) if last == ")" or "[" in head or last in ("mutable", "noexcept") else ("other", brace)
        if "=" in head and "operator" not in head:
            return ("block" if "[" in head else "other"), brace
        return "function", start

    def _go(self, head: list[str], start: int, brace: int, inside: str) -> tuple[str, int]:
        if not head:
            return ("block", brace) if inside in ("function", "block") else ("other", brace)
        if head[0] == "func" and inside == "":
            return "function", start
        last = head[-1]
        if last in ("struct", "interface") or head[0] in ("switch", "select", "type"):
            return "other", brace
        if "func" in head or head[0] in ("if", "for", "else") or last == "else":
            return "block", brace
        return "other", brace

    def _java(self, head: list[str], start: int, brace: int, inside: str) -> tuple[str, int]:
        last = head[-1] if head else ""
        if last == "->" or last in ("else", "do", "try", "finally", "static") and not (set(head) & {"class", "interface", "enum"}):
            return "block", brace
        if "new" in head:
            return ("type", brace) if last == ")" else ("other", brace)
        if set(head) & {"class", "interface", "enum", "record"} and "(" not in head[: head.index("class")] if "class" in head else set(head) & {"interface", "enum"}:
            return "type", start
        if not head:
            return ("block", brace) if inside in ("function", "constructor", "block") else ("other", brace)
        if "switch" in head:
            return "other", brace
        if set(head) & {"if", "for", "while", "catch", "synchronized", "try"} and inside != "type":
            return "block", brace
        if inside == "type" and "(" in head and "=" not in head:
            at = head.index("(")
            while at >= 2 and head[at - 2] == "@" and "(" in head[at + 1 :]:
                at = head.index("(", at + 1)
            before = [h for h in head[:at] if h not in ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native")]
            plain = len(before) == 1 or len(before) >= 2 and before[-2] in (">",) and before[0] == "<"
            return ("constructor" if plain else "function"), start
        return "other", brace

    def _script(self, head: list[str], start: int, brace: int, inside: str) -> tuple[str, int]:
        last = head[-1] if head else ""
        if last == "=>":
            arrow = brace - 1
            left = arrow - 1
            begin = self.partner.get(left, left) if self.tokens[left].text == ")" else left
            if begin and self.tokens[begin - 1].text == "async":
                begin -= 1
            return "function", begin
        if last in ("else", "do", "try", "finally"):
            return "block", brace
        if "function" in head:
            at = max(i for i in range(start, brace) if self.tokens[i].text == "function")
            starred = self.tokens[at + 1].text == "*"
            if at and self.tokens[at - 1].text == "async":
                at -= 1
            return ("block" if starred else "function"), (brace if starred else at)
        if "class" in head or "interface" in head or "enum" in head or "namespace" in head:
            return "type", start
        if head and head[0] in ("if", "for", "while", "catch", "with"):
            return "block", brace
        if head and head[0] == "switch":
            return "other", brace
        if inside in ("type", "other") and "(" in head and last != "=" and not (set(head) & {"=", "?", "new"}):
            return "function", start
        if not head:
            return ("block", brace) if inside in ("", "function", "block") and self._statement_before(brace) else ("other", brace)
        return "other", brace

    def _statement_before(self, brace: int) -> bool:
        return brace == 0 or self.tokens[brace - 1].text in (";", "{", "}")

    def _php(self, head: list[str], start: int, brace: int, inside: str) -> tuple[str, int]:
        last = head[-1] if head else ""
        if "function" in head:
            at = head.index("function")
            named = at + 1 < len(head) and head[at + 1] != "(" and not (head[at + 1] == "&" and head[at + 2] == "(")
            return ("function", start) if named else ("block", brace)
        if set(head) & {"class", "interface", "trait", "enum"}:
            return "type", start
        if head and head[0] in ("switch", "match") or "match" in head:
            return "other", brace
        if head and (head[0] in ("if", "for", "foreach", "while", "catch", "elseif", "else", "declare") or last in ("else", "do", "try", "finally")):
            return "block", brace
        if not head and inside in ("function", "block", ""):
            return "block", brace
        return "other", brace

    def _rust(self, head: list[str], start: int, brace: int, inside: str) -> tuple[str, int]:
        last = head[-1] if head else ""
        if "fn" in head and last != "=>":
            at = head.index("fn")
            if at + 1 < len(head) and head[at + 1] != "(":
                return "function", start
        if last in ("=>", "else", "loop", "unsafe", "async", "move") or not head and inside in ("function", "block", "other"):
            return "block", brace
        if set(head) & {"struct", "enum", "impl", "trait", "mod", "union", "extern"} and inside not in ("function", "block"):
            return "type", start
        if last == "!" or "macro_rules" in head or "use" in head[:1]:
            return "other", brace
        opener = next((h for h in reversed(head) if h in ("match", "if", "while", "for", "=", "return")), "")
        if opener == "match":
            return "other", brace
        if opener in ("if", "while", "for"):
            return "block", brace
        if last in ("|", "||") or last in ("=",):
            return "block", brace
        return "other", brace

    # ---------------------------------------------------------------------------

    def names(self, start: int, stop: int) -> list[str]:
        """The tokens between two places, in order."""
        floor = self.tokens[start].skipped
        out: list[str] = []
        i = start
        while i <= stop:
            t = self.tokens[i]
            if not t.is_name or t.skipped > floor:
                i += 1
                continue
            if self.language in ("rust",) and i + 2 <= stop and self.tokens[i + 1].text == "::" and self.tokens[i + 2].is_name:
                chain = [t.text]
                while i + 2 <= stop and self.tokens[i + 1].text == "::" and self.tokens[i + 2].is_name:
                    chain.append(self.tokens[i + 2].text)
                    i += 2
                out += ["::".join(chain[:k]) for k in range(len(chain), 1, -1)]
                out += [c for c in chain if c not in self.keywords]
            elif t.text not in self.keywords:
                out.append(t.text.removeprefix("$") if self.language == "php" else t.text)
            i += 1
        return [n for n in out if token_allowed(n)]

    def blocks(self) -> list[Block]:
        """Functions and blocks in the order in which they begin, outer ones first."""
        out: list[Block] = []
        around: list[tuple[int, str]] = []  # closing brace and kind
        for i, t in enumerate(self.tokens):
            while around and i > around[-1][0]:
                around.pop()
            if t.text != "{" or t.is_name or i not in self.partner:
                continue
            stop = self.partner[i]
            kind, start = self.judge(i, around[-1][1] if around else "")
            around.append((stop, kind))
            if kind in ("function", "constructor"):
                out.append(Block("function", self.tokens[start].line, self.tokens[stop].line, tuple(self.names(start, stop))))
            if kind in ("function", "block"):
                body = Block("block", t.line, self.tokens[stop].line, tuple(self.names(i, stop)))
                if body.end_line - body.start_line >= MIN_BLOCK_ROWS:
                    out.append(body)
        return out


def find_blocks(text: str, language: str, min_tokens: int = 3) -> list[Block]:
    """All functions and long enough blocks of a source; nested ones too."""
    if language not in LEXERS:
        return []
    found = BlockFinder(tokenize(text, language), language).blocks()
    return [b for b in found if len(b.tokens) >= max(1, min_tokens)]
