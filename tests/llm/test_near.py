"""N-gram join, components and the pipeline against brute force."""

import random
import re

import pytest
from test_text_ops import brute_hits, brute_lines, same_rows

import corpus_pipeline
from simloom.llm import components, language_id, ngram_join
from simloom.llm.oracles import ORACLES
from simloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, root string, n long"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def drifting(seed, n, size):
    """A chain of texts, each a few words off the one before."""
    r = random.Random(seed)
    words = [f"w{r.randint(0, 999)}" for _ in range(size)]
    for _ in range(n):
        for _ in range(r.randint(0, 4)):
            words[r.randrange(size)] = f"w{r.randint(0, 999)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = [t for s in range(4) for t in drifting(s, 14, 60)] + [*drifting(9, 50, 30)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{r.randint(0, 99)}" for _ in range(r.randint(0, 30))) for _ in range(20)]
    texts += [None, "", "  ", "one two", "One  TWO", "a b c d e", "a b c d e f", "long " * 3000, texts[0].upper(), texts[0], texts[0]]
    r.shuffle(texts)
    return [*enumerate(texts), (None, texts[3]), (7, texts[7]), (None, "")]


@pytest.mark.parametrize("short,bits", [(32, 17), (3, 4)])
def test_join(spark, rows, short, bits):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    found = ngram_join.join_report(df, short_list=short, sketch_bits=bits).collect()
    assert sorted((tuple(x) for x in found), key=str) == brute(rows)


def test_join_stage_keeps_the_first(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = ngram_join.keep_first_of_each(df)
    expected = {d for d, _, c in brute(rows) if d is not None and d == c}
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} == expected
    assert kept.where("doc_id IS NULL").count() == 2
    assert ngram_join.join_report(df.limit(0)).count() == 0


def test_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            need = next(i for i in range(a + 1) if 100 * i >= 80 * (a + b - i)) if 100 * a >= 80 * b else None
            if need is not None:
                assert ngram_join.least_overlap(a, b) == need
                assert ngram_join.least_shared(a, b) >= 1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    found = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: find(i) for i in root if find(i) != i}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, DATA)
        now = spark.createDataFrame(out.collect(), out.schema)
        if k < 4:
            assert out.columns == docs.columns
        after = {r.doc_id: r for r in now.collect()}
        rows = [(d, r.text) for d, r in before.items()]
        if name == "language_id":
            net = language_id.fit(docs)
            good = {r.doc_id for r in language_id.identify(docs, net).collect() if r.lang_pred != "und" and r.score >= 0.3}
            assert set(after) == good and len(good) >= 0.98 * len(before)
            assert all(after[d] == before[d] for d in after)
        elif name == "line_dedup":
            report = {d: n for d, _, n, _ in brute_lines(rows)}
            assert set(after) == set(before)
            assert all((after[d].text == before[d].text) == (report[d] == 0) for d in after)
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, _, c in brute(rows) if d == c}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(after) == {d for d, *_, bad in brute_hits(rows, items) if not bad}
        else:
            assert set(after) == set(before) and all(r.n_tokens >= 0 for r in after.values())
    assert corpus_pipeline.run(spark, DATA).count() == len(after)


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing names, no language, an empty table."""
    item = "one two three four five six seven eight nine ten eleven"
    text = "some words that make a text long enough to be a document of its own number "
    rows = [(i, text * 3 + "".join(chr(97 + int(c)) for c in str(i)) * 4, "en", "s", 1, 7, 8) for i in range(40)]
    rows += [rows[3], (None, text + "nameless", "en", "s", 1, 7, 8), (50, None, "en", "s", 1, 7, 8), (51, "", None, None, None, 7, 8), (52, "12 !", "en", "s", 1, 7, 8)]
    rows += [(53, f"quite another thing {item} at the end", "en", "s", 1, 7, 8), (54, "word " * 30_000 + "end", "en", "s", 1, 7, 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc long, slot long"
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("rows", rows), ("no language", [(*r[:2], None, *r[3:]) for r in rows]), ("none", [])):
        now = spark.createDataFrame(some, schema)
        for stage, function in corpus_pipeline.STAGES:
            out = function(spark, now, str(tmp_path))
            if stage != "bpe":
                assert out.columns == now.columns
            now = spark.createDataFrame(out.collect(), out.schema)
        ids = [r.doc_id for r in now.collect()]
        if name == "none":
            assert ids == []
        else:
            assert not {50, 51, 52, 53} & set(ids) and {0, 54, None} <= set(ids)
