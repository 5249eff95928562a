"""Blocks and their features: term frequencies, counts, SimHash, signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions import signatures as sig
from simloom.functions.tokens import text_tokens
from simloom.storage import written

BLOCK = "block_id long, file string, start_line int, end_line int, tokens array<string>"


def text_blocks(df: DataFrame, id_col: str, text_col: str, file_col: str | None = None, min_tokens: int = 3) -> DataFrame:
    """One block per row of prose; its lines are the text's. Small blocks are left out."""
    blocks = df.select(
        F.col(id_col).cast("long").alias("block_id"),
        F.col(file_col or id_col).cast("string").alias("file"),
        F.lit(1).alias("start_line"),
        F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("end_line"),
        text_tokens(F.col(text_col)).alias("tokens"),
    )
    return blocks.where(F.size("tokens") >= min_tokens)


def token_counts(blocks: DataFrame) -> DataFrame:
    """A row per block: total, distinct, first and last token."""
    return blocks.select(
        "block_id",
        F.size("tokens").alias("total_tokens"),
        F.size(F.array_distinct("tokens")).alias("distinct_tokens"),
        F.element_at("tokens", 1).alias("first_token"),
        F.element_at("tokens", -1).alias("last_token"),
    )


TERMS = "block_id long, token string, cnt long, total int"


def term_frequencies(blocks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per block and token: count and share of the block's occurrences.

    Tokens are counted where their block is read, so nothing but ids is shuffled. Only blocks whose
    id occurs again are put together by an aggregate. ``ids`` (block_id) may name a table cheaper to
    read that has all ids of the blocks.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column(1)
                coded = column.flatten().dictionary_encode()
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                words = max(1, len(coded.dictionary))
                own, n = np.unique(row * words + coded.indices.to_numpy(), return_counts=True)
                rows = pa.array(own // words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), coded.dictionary.take(pa.array(own % words)), pa.array(n), pa.array(sizes[own // words].astype(np.int32))],
                    names=[c.split()[0] for c in TERMS.split(", ")],
                )

    rows = blocks.select("block_id", "tokens").mapInArrow(counted, TERMS)
    tf = (F.col("cnt") / F.col("total")).alias("tf")
    ids = blocks if ids is None else ids
    again = written(ids.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block_id"), "repeated")
    if again.isEmpty():
        return rows.select("block_id", "token", "cnt", tf)
    same = rows["block_id"].eqNullSafe(again["block_id"])
    summed = rows.join(again, same, "left_semi").groupBy("block_id", "token").agg(F.sum("cnt").alias("cnt"), F.first("total").alias("total"))
    return rows.join(again, same, "left_anti").unionByName(summed).select("block_id", "token", "cnt", tf)


def simhash_by_columns(terms: DataFrame) -> DataFrame:
    """SimHash from a term table with columns alone; the sums are combined before the one shuffle by block."""
    hashed = terms.withColumn("h", sig.hash64(F.col("token")))
    sums = [sig.bit_sum(F.col("h"), F.col("cnt"), i).alias(f"s{i}") for i in range(sig.BITS)]
    summed = hashed.groupBy("block_id").agg(*sums)
    return summed.select("block_id", sig.simhash_of_sums([F.col(f"s{i}") for i in range(sig.BITS)]).alias("simhash"))


FEATURES = (
    "block_id long, file string, start_line int, end_line int, total int, distinct int, first_token string, "
    "last_token string, simhash long, keys array<long>, counts array<int>, places array<int>, head array<long>"
)
#: Leading tokens that the overlap filter looks at.
HEAD = 20


def md5_keys(tokens: list[str]) -> np.ndarray:
    digests = b"".join(hashlib.md5(t.encode()).digest()[:8] for t in tokens)
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def block_features(blocks: DataFrame, names: bool = False) -> DataFrame:
    """All features of a block in one Arrow pass without a shuffle.

    ``keys`` are the sorted 64-bit hashes of the distinct tokens, ``counts``
    their occurrences, ``places`` where they first occur, ``head`` the hashes of
    the first tokens. With ``names`` there are also the tokens of the keys.
    """

    schema = FEATURES + (", names array<string>" if names else "")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column(4)
                coded = column.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                table = md5_keys(words) if words else np.zeros(0, np.uint64)
                signs = (np.unpackbits(table.view(np.uint8).reshape(-1, 8)[:, ::-1].copy(), axis=1).astype(np.int32) * 2 - 1) if words else np.zeros((0, 64), np.int32)
                codes = coded.indices.to_numpy()
                sizes = np.array([len(x) for x in column], np.int64)
                cut = np.concatenate([[0], np.cumsum(sizes)])
                keys, counts, places, heads, hashes, own_words = [], [], [], [], [], []
                for a, b in zip(cut, cut[1:]):
                    own, first, n = np.unique(codes[a:b], return_index=True, return_counts=True)
                    order = np.argsort(table[own])
                    keys.append(table[own][order])
                    counts.append(n[order])
                    places.append(first[order])
                    own_words.append(own[order])
                    heads.append(table[codes[a : min(b, a + HEAD)]])
                    ones = (signs[own] * n[:, None]).sum(0) > 0
                    hashes.append(int.from_bytes(np.packbits(ones).tobytes(), signed=True))
                d = [len(k) for k in keys]
                join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
                ends = [(words[codes[a]], words[codes[b - 1]]) if b > a else (None, None) for a, b in zip(cut, cut[1:])]
                more = []
                if names:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(d)]).astype(np.int32))
                    more.append(pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(join(own_words, np.int64)))))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:4],
                        pa.array(sizes, pa.int32()),
                        pa.array(d, pa.int32()),
                        pa.array([e[0] for e in ends], pa.string()),
                        pa.array([e[1] for e in ends], pa.string()),
                        pa.array(hashes, pa.int64()),
                        _lists(join(keys, np.uint64).view(np.int64), d, pa.int64()),
                        _lists(join(counts, np.int32), d, pa.int32()),
                        _lists(join(places, np.int32), d, pa.int32()),
                        _lists(join(heads, np.uint64).view(np.int64), [len(h) for h in heads], pa.int64()),
                        *more,
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return blocks.select("block_id", "file", "start_line", "end_line", "tokens").mapInArrow(features, schema)
