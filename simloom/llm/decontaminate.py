"""Benchmark decontamination by winnowing.

A window of w k-gram hashes keeps its least one, so that two texts sharing at
least w + k - 1 words share a kept hash. Document and benchmark fingerprints
are joined on the hash, each hit is extended over the words on both sides, and
runs that reach the length of a window are hits. With k = 5 and w = 6 every
shared span of ten words is found. Items shorter than that have one fingerprint,
the hash of all their words, which documents meet with all runs of that many
words; no window could promise them.

Both sides are tables: items are numbered and their fingerprints written by
tasks. A bit field of those, of bounded size, keeps most document fingerprints
from leaving the task that found them, and only documents with one that passes
go on with their text. The field may let some through, never keep one out; a
benchmark too large for it lets all through. The benchmark's side of the joins
is broadcast below a checked size; beyond, adaptive execution splits skewed keys.

Results for odd input: a null text has no words and no hits; an item without
words occurs nowhere; repeated items count once each by their id (equal ids
once); equal documents get equal results; an empty benchmark leaves all clean.
Rows with a null id come back with it; items with a null id are searched like
others and count as one item without a name. A very long text is searched whole,
as a slice of its own. Extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.line_dedup import ROW, column, row_key
from simloom.llm.shared import bit_field, field_bits, in_field, map_arrow, release_memory, slices, text_buffer, written
from simloom.llm.words import ALPHANUMERIC, LOWER, grams, hash_spans, word_spans

SPAN, K = 10, 5
#: Most rows, and bytes, of the benchmark's side of a join that are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Bits of the field for each fingerprint: a document has many that it must keep apart.
FIELD_EACH = 1024
#: Row slots by which dirty documents are told from most others: at most so many numbers are broadcast.
SLOTS = 1 << 18


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept hashes: the least of every window, the last one of equals."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    kept = np.zeros(n, bool)
    for at in range(0, len(views), 1 << 16):
        part = views[at : at + (1 << 16)]
        kept[at + np.arange(len(part)) + window - 1 - np.argmin(part[:, ::-1], axis=1)] = True
    return np.flatnonzero(kept)


class Words:
    """The words of a text: hashes, and bytes to be sure."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.low, self.starts, self.ends, self.hashes = low, starts, ends, hashes

    def __len__(self) -> int:
        return len(self.hashes)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()

    def same(self, i: int, other: Words, j: int, n: int) -> bool:
        """Whether n words are the same, by their bytes."""
        return all(self.word(i + m) == other.word(j + m) for m in range(n))


def words_of(column: pa.Array) -> list[Words]:
    """The words of each text of a column; null has none."""
    data, offsets = text_buffer(column)
    low = LOWER[data]
    starts, ends = word_spans(low, offsets, ALPHANUMERIC)
    hashes = hash_spans(low, starts, ends)
    first = np.searchsorted(starts, offsets).tolist()
    return [Words(low, starts[a:b], ends[a:b], hashes[a:b]) for a, b in zip(first, first[1:])]


def fingerprints(words: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their places."""
    h = grams(words.hashes, k)
    at = winnow(h, span - k + 1)
    return h[at], at


def shared_runs(doc: Words, item: Words, places: Iterable[tuple[int, int]], span: int, k: int) -> list[tuple[int, int]]:
    """Runs of the document's words that an item's windows cover, from places of equal hashes."""
    runs, done = [], {}  # by diagonal: words done up to here
    for at, there in sorted(places):
        if len(item) < span:
            begin, end = at, at + len(item)
        elif done.get(at - there, -1) > at:
            continue
        else:
            begin, end = _extend(doc.hashes, at, item.hashes, there)
            done[at - there] = end
        if end - begin >= min(span, len(item)) and doc.same(begin, item, there - at + begin, end - begin):
            runs.append((begin, end))
    return runs


def _extend(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """The longest run of equal words around a[i] and b[j]."""
    back = min(i, j)
    differ = np.flatnonzero(a[i - back : i] != b[j - back : j])
    begin = i - back + (int(differ[-1]) + 1 if len(differ) else 0)
    ahead = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + ahead] != b[j : j + ahead])
    return begin, i + (int(differ[0]) if len(differ) else ahead)


# --- the tables that are joined ---------------------------------------------------

PRINTS = "hash long, item long, there int, words int"


def item_prints(items: DataFrame, span: int, k: int) -> DataFrame:
    """Fingerprints of numbered items (item, text); ``words`` is the size of their windows."""

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            for item, words in zip(part.column(0), words_of(part.column(1))):
                n = len(words)
                if not n:
                    continue
                h, at = fingerprints(words, span, k) if n >= span else (grams(words.hashes, n), np.zeros(1, np.int64))
                fixed = [pa.array(np.full(len(h), item.as_py())), pa.array(at.astype(np.int32)), pa.array(np.full(len(h), min(n, span), np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *fixed], names=["hash", "item", "there", "words"])

    return map_arrow(items.select("item", "text"), prints, PRINTS)


SCANNED = "doc_id long, doc long, t1 long, t2 long, n_words long, text string, prints array<struct<hash: bigint, at: int>>"


def _scanner(field: np.ndarray | None, short: list[int], span: int, k: int):
    """A function from batches of (doc_id, row, text) to words counted and fingerprints that
    pass the field; a row without one goes on without its text."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None if field is None else np.uint64(8 * len(field.value) - 1)
        passed = lambda h: np.ones(len(h), bool) if mask is None else in_field(field.value, (h & mask).astype(np.int64))
        for part in slices(batches, 4):
            hashes, places, sizes, n_words = [], [], [], []
            for words in words_of(part.column(4)):
                h, at = fingerprints(words, span, k)
                ok = passed(h)
                own_h, own_at = [h[ok]], [at[ok]]
                for n in short:
                    h = grams(words.hashes, n)
                    at = np.flatnonzero(passed(h))
                    own_h.append(h[at])
                    own_at.append(at)
                hashes += own_h
                places += own_at
                sizes.append(sum(map(len, own_h)))
                n_words.append(len(words))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32))], names=["hash", "at"]
            )
            prints = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            text = part.column(4).take(pa.array([i if s else None for i, s in enumerate(sizes)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(n_words, pa.int64()), text, prints], names=[c.split()[0] for c in SCANNED.split(", ")[:7]])
        release_memory()

    return scan


RUNS = "doc long, t1 long, t2 long, id string, runs array<struct<begin: int, end: int>>"


def _extender(span: int, k: int):
    """A function from batches of (row, id, text, item text, places) to runs hit."""

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], 4):
                docs: dict[tuple, Words] = {}
                rows, runs = [], []
                items = words_of(part.column(5))
                for i, (key, places) in enumerate(zip(zip(*(c.to_pylist() for c in part.columns[:3])), part.column(6).to_pylist())):
                    if key not in docs:
                        docs[key] = words_of(part.column(4).slice(i, 1))[0]
                    found = shared_runs(docs[key], items[i], [(p["at"], p["there"]) for p in places], span, k)
                    if found:
                        rows.append(i)
                        runs.append([{"begin": a, "end": b} for a, b in found])
                kept = part.take(pa.array(rows, pa.int64()))
                column = pa.array(runs, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*kept.columns[:4], column], names=["doc", "t1", "t2", "id", "runs"])

    return extend


# --- the operator -----------------------------------------------------------------


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, row, n_words), and per row that is hit its ``n_hit`` and ``items``."""
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and the span")
    spark = docs.sparkSession
    numbered = items.select(column(item_col).cast("string").alias("id"), column(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    numbered = written(numbered.withColumn("item", F.monotonically_increasing_id()), "benchmark")
    prints = written(item_prints(numbered, span, k), "benchmark-prints")
    count, text_bytes = prints.count(), numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = field_bits(count, FIELD_EACH)
    field = None if bits is None else spark.sparkContext.broadcast(bit_field(prints.select(F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))), bits))
    short = sorted(r.words for r in prints.where(F.col("words") < span).select("words").distinct().collect())  # below the span
    text = column(text_col)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), *row_key(column(id_col), F.coalesce(text, F.lit(""))), text.alias("text"))
    scanned = written(map_arrow(rows, _scanner(field, short, span, k), SCANNED), "scanned")
    some = scanned.where("text IS NOT NULL").dropDuplicates(ROW)
    bounded = lambda df, ok: F.broadcast(df) if ok else df
    met = some.select(*ROW, F.explode("prints").alias("p")).select(*ROW, "p.hash", "p.at").join(bounded(prints, count <= BROADCAST_ROWS), "hash")
    pairs = met.groupBy(*ROW, "item").agg(F.collect_list(F.struct("at", "there")).alias("places"))
    texts = numbered.select("item", "id", F.col("text").alias("item_text"))
    both = pairs.join(bounded(texts, text_bytes <= BROADCAST_BYTES), "item").join(some.select(*ROW, "text"), ROW)
    runs = map_arrow(both.select(*ROW, "id", "text", "item_text", "places"), _extender(span, k), RUNS)
    joined = runs.groupBy(*ROW).agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.collect_set(F.struct("id")).alias("ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, r):
        more = F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], acc["end"]))
        return F.struct(F.greatest(acc["end"], r["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return scanned.drop("text", "prints"), joined.select(*ROW, F.aggregate("runs", zero, add)["n"].alias("n_hit"), F.array_sort(F.transform("ids", lambda x: x["id"])).alias("items"))


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    k: int = K,
) -> DataFrame:
    """A row per document: words, words hit, items that occur (sorted as strings, a null last)."""
    rows, hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, span, k)
    none = F.array().cast("array<string>")
    return rows.join(hits, ROW, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    k: int = K,
) -> DataFrame:
    """The documents without a hit, as they were.

    Only rows that share a hash slot with a dirty one are shuffled.
    """
    _, hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, span, k)
    dirty = written(hits.select(*ROW), "dirty")
    slot = lambda: F.pmod("t1", F.lit(SLOTS)).cast("int").alias("slot")
    slots = F.broadcast(dirty.select(slot()).distinct())  # at most SLOTS numbers
    row = F.struct(*map(column, docs.columns)).alias("row")
    keyed = docs.select(row, *row_key(column(id_col), F.coalesce(column(text_col), F.lit("")))).withColumn("slot", slot())
    sure = keyed.join(slots, "slot", "left_anti").select("row")
    rest = keyed.join(slots, "slot", "left_semi").join(dirty, ROW, "left_anti").select("row")
    return sure.unionByName(rest).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def decontamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    hits = find_hits(docs, items, **options)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
