import os
import time

import numpy as np
import pytest
from compare import fuzzy_cosine
from pyspark.sql import functions as F

from simloom.functions import identifiers as ident
from simloom.functions import paths
from simloom.functions import signatures as sig
from simloom.operators import candidates, features, fuzzy, score, synonyms

IGNORE_CASES = [
    ("vendor/a.c", "vendor/**", True),
    ("src/vendor/a.c", "vendor/**", False),
    ("build_x/a.c", "build_*/**", False),
    ("src/build/a.c", "**/build/**", True),
    ("build/a.c", "**/build/**", False),
    ("src/generated/a.cpp", "**/generated/*.cpp", False),
    ("src/_deps/x.c", "**/_deps/**", True),
    ("src/a.rs", "*.rs", True),
    ("a.d/x.c", "a.d/**", False),
    ("src/ab.c", "src/a?.c", False),
    ("src/a.c", "src", True),
    ("srcx/a.c", "src", False),
]


def test_ignore_patterns(spark):
    for path, pattern, expected in IGNORE_CASES:
        assert paths.is_ignored(path, [pattern]) is expected
        row = spark.createDataFrame([(path,)], "p string").select(paths.ignored(F.col("p"), [pattern]).alias("x")).first()
        assert row.x is expected
    assert paths.is_ignored("build_x/a.c", ["build_*/**"], "strict")


IDS = {
    "calculateSum": (["calculate", "sum"], 33474),
    "obtainTotal": (["obtain", "total"], 33486),
    "getItem": (["get", "item"], 33414),
    "make_object": (["make", "object"], 8908),
    "HTTPServer": (["h", "t", "t", "p", "server"], 19079),
}
DICTIONARY = "get|fetch,retrieve,obtain\nmake|create,build,construct\nsum|total,aggregate\nbad line\n a | |b"


def test_identifiers(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "i string")
    rows = df.select("i", ident.split_words(F.col("i")).alias("w"), ident.bitmap_signature(F.col("i")).alias("s")).collect()
    assert {r.i: (r.w, r.s) for r in rows} == IDS


@pytest.fixture(scope="module")
def edges(spark):
    return synonyms.small_dictionary(spark, DICTIONARY).cache()


def test_expansion(spark, edges):
    df = spark.createDataFrame([("calculateSum",), ("obtainTotal",), ("getItem",)], "identifier string")
    found = {}
    for r in synonyms.expand(df, edges).collect():
        found.setdefault(r.identifier, {})[r.word] = round(r.score, 5)
    assert found["calculateSum"] == {"calculate": 1, "sum": 1, "total": 0.9, "aggregate": 0.9}
    assert found["obtainTotal"] == {"obtain": 1, "get": 0.9, "fetch": 0.81, "retrieve": 0.81, "total": 1, "sum": 0.9, "aggregate": 0.81}
    assert found["getItem"] == {"get": 1, "fetch": 0.9, "retrieve": 0.9, "obtain": 0.9, "item": 1}


SIMILAR = [
    ("calculateSum", "obtainTotal", True, 0.562283),
    ("calculateSum", "computeTotal", True, 0.713960),
    ("getItem", "fetchItem", True, 0.996413),
    ("makeObject", "createObject", True, 0.996413),
    ("std_sum", "sumTotal", True, 0.846426),
    ("getItem", "destroyElement", False, 0.0),
    ("fetch", "build", False, 0.0),
    ("x", "getVeryLongUserName", False, 0.0),
]


def test_identifier_similarity(spark, edges):
    pairs = spark.createDataFrame([(a, b) for a, b, *_ in SIMILAR], "id1 string, id2 string")
    found = {(r.id1, r.id2): r for r in synonyms.similarity(pairs, edges).collect()}
    for a, b, fast, value in SIMILAR:
        assert found[a, b].fast is fast
        assert found[a, b].similarity == pytest.approx(value, abs=1e-5)


def test_indexes(spark, edges, tmp_path):
    ids = spark.createDataFrame([(i,) for i in ("getItem", "fetchItem", "setValue", "updateValue", "calculateSum", "x")], "identifier string")
    near = {(r.identifier, r.candidate) for r in synonyms.candidates_by_words(ids, synonyms.word_index(ids)).collect()}
    assert ("getItem", "fetchItem") in near and ("getItem", "setValue") not in near
    ranged = {(r.query, r.candidate) for r in synonyms.signature_range(ids, ids, 12).collect()}
    assert ("calculateSum", "calculateSum") in ranged and ("calculateSum", "x") not in ranged and ("setValue", "updateValue") in ranged
    synonyms.save_edges(edges, str(tmp_path / "e"))
    assert sorted(synonyms.load_edges(spark, str(tmp_path / "e")).collect()) == sorted(edges.collect())


COSINES = [
    ("foo bar baz", "foo bar baz", {0: 1, 1: 1, 2: 1, 5: 1}, 1, 1),
    ("foo bar baz", "foo bar qux", {0: 0.666667, 1: 0.529412, 2: 0.418605, 5: 0.219512}, 0.418605, 0.418605),
    ("foo foo bar baz", "foo bar baz baz", {0: 0.833333, 1: 0.837992, 2: 0.841149, 5: 0.846465}, 0.522266, 0.522266),
    ("foo bar baz", "foo foo bar baz", {0: 0.942809, 1: 0.943220, 2: 0.943841, 5: 0.945250}, 0.546383, 0.944966),
    ("calculateSum getItem items result items", "calculateTotal fetchItem items result items", {2: 0.465922}, 0.707096, 0.707096),
]


def _blocks(spark, texts):
    rows = [(i, str(i), 1, 1, t.split()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, features.BLOCK)


@pytest.mark.parametrize("a,b,exact,ab,ba", COSINES)
def test_cosine(spark, edges, a, b, exact, ab, ba):
    blocks = _blocks(spark, [a, b])
    pairs = spark.createDataFrame([(0, 1)], "id_a long, id_b long")
    terms, found = features.term_frequencies(blocks), features.block_features(blocks)
    for p, value in exact.items():
        assert score.relational_scores(pairs, terms, p).first().similarity == pytest.approx(value, abs=1e-6)
        assert score.score_pairs(pairs, found, p).first().similarity == pytest.approx(value, abs=1e-6)
    for ways, expected in (((True, True), max(ab, ba)), ((True, False), ab), ((False, True), ba)):
        marked = spark.createDataFrame([(0, 1, *ways)], "id_a long, id_b long, ab boolean, ba boolean")
        assert fuzzy.fuzzy_scores(marked, blocks, found, edges, 2.0).first().fuzzy == pytest.approx(expected, abs=1e-6)


def test_fuzzy_is_directed():
    a, b = "foo bar baz".split(), "foo foo bar baz".split()
    assert fuzzy_cosine(a, b, {}, 2.0) == pytest.approx(0.546383, abs=1e-6)
    assert fuzzy_cosine(b, a, {}, 2.0) == pytest.approx(0.944966, abs=1e-6)
    assert fuzzy_cosine([], b, {}, 2.0) == 0.0


def test_simhash_forms_agree(spark):
    texts = ["foo bar baz", "foo foo bar", "aa bb cc dd ee ff", "bb aa dd cc ff ee", "one two"]
    blocks = _blocks(spark, texts)
    a = {r.block_id: r.simhash for r in features.block_features(blocks).collect()}
    b = {r.block_id: r.simhash for r in features.simhash_by_columns(features.term_frequencies(blocks)).collect()}
    assert a == b and a[2] == a[3]
    empty = features.block_features(spark.createDataFrame([(9, "f", 1, 1, [])], features.BLOCK)).first()
    assert (empty.simhash, empty.total, empty.first_token) == (0, 0, None)


def test_bands_find_every_near_pair(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = int(r.integers(0, 2**62))
    rows = []
    for i in range(60):
        h = base
        for bit in r.choice(64, int(r.integers(0, 14)), replace=False):
            h ^= 1 << int(bit)
        rows.append((i, str(i % 50), int(r.choice([10, 20, 21, 40])), h - (1 << 64) if h >> 63 else h))
    df = spark.createDataFrame(rows, "block_id long, file string, total int, simhash long")
    expected = {
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and a[1] != b[1] and a[2] <= 2 * b[2] and b[2] <= 2 * a[2] and ((a[3] ^ b[3]) & (2**64 - 1)).bit_count() <= 10
    }
    for agreeing in (None, 1, 2, 3):
        for part in (4096, 7):
            monkeypatch.setattr(candidates, "PART", part)
            found = [(x.id_a, x.id_b) for x in candidates.paired(df, agreeing=agreeing).collect()]
            assert len(found) == len(set(found)) and set(found) == expected
    half = [r for r in rows if r[0] % 2]
    other = [r for r in rows if not r[0] % 2]
    schema = "block_id long, file string, total int, simhash long"
    found = [(x.id_a, x.id_b) for x in candidates.paired(spark.createDataFrame(half, schema), spark.createDataFrame(other, schema)).collect()]
    close = {
        (a[0], b[0]) for a in half for b in other
        if a[2] <= 2 * b[2] and b[2] <= 2 * a[2] and ((a[3] ^ b[3]) & (2**64 - 1)).bit_count() <= 10
    }
    assert len(found) == len(set(found)) and set(found) == close


def test_overlap_and_ratio(spark):
    long = " ".join(f"w{i:02d}" for i in range(20)) + " shared"
    blocks = _blocks(spark, [long, "shared " + " ".join(f"v{i:02d}" for i in range(30)), "v00 v01 v02"])
    found = features.block_features(blocks)
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "id_a long, id_b long")
    assert [(r.id_a, r.id_b, r.ab, r.ba) for r in score.score_pairs(pairs, found).collect()] == [(1, 2, True, True)]
    assert score.score_pairs(pairs, found, overlap=False).count() == 2
    # Of equal lengths the second block's first tokens count.
    even = _blocks(spark, [long, "shared " + " ".join(f"v{i:02d}" for i in range(20))])
    r = score.score_pairs(spark.createDataFrame([(0, 1)], "id_a long, id_b long"), features.block_features(even)).first()
    assert (r.ab, r.ba) == (True, False)
    row = spark.range(1).select(*(candidates.size_ratio_ok(F.lit(a), F.lit(b)).alias(f"x{i}") for i, (a, b) in enumerate([(10, 20), (20, 10), (10, 21)]))).first()
    assert tuple(row) == (True, True, False)


def test_signature_columns(spark):
    row = spark.range(1).select(sig.count_bucket(F.lit(25)).alias("a"), sig.count_bucket(F.lit(501)).alias("b"), sig.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("c")).first()
    assert tuple(row) == (1, 6, 64)


def test_estimate(spark):
    row = spark.range(1).select(candidates.estimate_ok(F.lit(10), 1.0).alias("a"), candidates.estimate_ok(F.lit(45), 1.0).alias("b")).first()
    assert tuple(row) == (True, False)


def test_cached_dictionary(spark, tmp_path):
    words, cache = tmp_path / "words.txt", str(tmp_path / "cache")
    words.write_text("get|fetch\n")
    os.utime(words, (1_000_000_000, 1_000_000_000))
    assert synonyms.cached_edges(spark, str(words), cache).count() == 2
    words.write_text("get|fetch,obtain\n")
    os.utime(words, (1_000_000_000, 1_000_000_000))
    assert synonyms.cached_edges(spark, str(words), cache).count() == 2  # not younger: kept
    os.utime(words)
    later = time.time() + 60
    os.utime(words, (later, later))
    assert synonyms.cached_edges(spark, str(words), cache).count() == 4
