"""Scores of pairs: frequency-penalised cosine, relational and vectorised."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.config import checked_penalty

PENALTY, THRESHOLD = 2.0, 0.85


def shared_cosine(shared_a: np.ndarray, shared_b: np.ndarray, norm_a: float, norm_b: float, penalty: float) -> float:
    """From the frequencies of shared tokens and the sums of all squared ones."""
    w2 = 1.0 / (1.0 + penalty * np.sqrt(shared_a * shared_b)) ** 2
    a2 = norm_a - (shared_a**2 * (1 - w2)).sum()
    b2 = norm_b - (shared_b**2 * (1 - w2)).sum()
    if a2 <= 0 or b2 <= 0:
        return 0.0
    return float((shared_a * shared_b * w2).sum() / np.sqrt(a2 * b2))


def relational_scores(pairs: DataFrame, terms: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """The score by a join on shared tokens; for checks and small inputs."""
    checked_penalty(penalty)
    norms = terms.groupBy("block_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("n2"))
    side = lambda s: terms.select(F.col("block_id").alias(f"id_{s}"), "token", F.col("tf").alias(f"f{s}"))
    norm = lambda s: norms.select(F.col("block_id").alias(f"id_{s}"), F.col("n2").alias(f"n2{s}"))
    shared = pairs.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), ["id_b", "token"])
    w2 = F.pow(1.0 / (1.0 + penalty * F.sqrt(F.col("fa") * F.col("fb"))), F.lit(2.0))
    sums = shared.groupBy("id_a", "id_b").agg(
        F.sum(F.col("fa") * F.col("fb") * w2).alias("dot"),
        F.sum(F.col("fa") * F.col("fa") * (1 - w2)).alias("ra"),
        F.sum(F.col("fb") * F.col("fb") * (1 - w2)).alias("rb"),
    )
    scored = pairs.join(sums, ["id_a", "id_b"], "left").join(norm("a"), "id_a").join(norm("b"), "id_b")
    similarity = F.col("dot") / F.sqrt((F.col("n2a") - F.col("ra")) * (F.col("n2b") - F.col("rb")))
    return scored.select("id_a", "id_b", F.coalesce(similarity, F.lit(0.0)).alias("similarity"))


#: Blocks of a part; the pairs between two parts are scored by one task, which gets each block once.
PART_BLOCKS = 5000
CARRIED = ("file", "start_line", "end_line")
SCORED = (
    "id_a long, id_b long, file_a string, start_line_a int, end_line_a int, file_b string, start_line_b int, end_line_b int, "
    "ab boolean, ba boolean, similarity double"
)


def list_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and where each begins; a null is empty."""
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy())])


class Blocks:
    """Features of the blocks that a task has, by id."""

    def __init__(self, table: pa.Table):
        self.table = table
        ids = table.column("block_id").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]
        self.total = table.column("total").to_numpy()
        keys, self.cuts = list_column(table, "keys")
        head, self.head_cuts = list_column(table, "head")
        self.keys, self.head = keys.view(np.uint64), head.view(np.uint64)
        self.counts = list_column(table, "counts")[0]
        self.share = self.counts / np.repeat(self.total, np.diff(self.cuts))
        self.norm = np.array([(self.share[a:b] ** 2).sum() for a, b in zip(self.cuts, self.cuts[1:])])

    def places(self, ids: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.sorted, ids)]

    def tokens(self, i: int) -> slice:
        return slice(self.cuts[i], self.cuts[i + 1])

    def meets(self, i: int, j: int) -> bool:
        """Whether one of the first tokens of i occurs in j."""
        return bool(found(self.head[self.head_cuts[i] : self.head_cuts[i + 1]], self.keys[self.tokens(j)])[1].any())

    def directions(self, i: int, j: int) -> tuple[bool, bool]:
        """The overlap test both ways: the smaller's first tokens, of equals the second's."""
        if self.total[i] < self.total[j]:
            ok = self.meets(i, j)
            return ok, ok
        ok = self.meets(j, i)
        return ok, ok if self.total[j] < self.total[i] else self.meets(i, j)

    def cosine(self, i: int, j: int, penalty: float) -> float:
        a, b = self.tokens(i), self.tokens(j)
        if a.start == a.stop or b.start == b.stop:
            return 0.0
        at, hit = found(self.keys[a], self.keys[b])
        return shared_cosine(self.share[a][hit], self.share[b][at[hit]], self.norm[i], self.norm[j], penalty)


def found(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted values in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def meeting(pairs: DataFrame, blocks: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet`` of pairs (id_a, id_b, ...) and the blocks (block_id, ...) that they name.

    Blocks are dealt into parts; the pairs between two parts meet their blocks in
    one task, so that a block in many pairs is sent once to each. Both inputs should
    be written tables.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    parts = max(int((8 * cores) ** 0.5) + 1, blocks.count() // PART_BLOCKS)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    keyed = pairs.withColumn("g", F.struct(part("id_a").alias("a"), part("id_b").alias("b")))
    needed = keyed.select(F.col("g").alias("h"), F.col("id_a").alias("block_id")).union(keyed.select("g", "id_b")).distinct()
    return keyed.groupBy("g").cogroup(needed.join(blocks, "block_id").groupBy("h")).applyInArrow(meet, schema)


def score_pairs(pairs: DataFrame, features: DataFrame, penalty: float = PENALTY, overlap: bool = True) -> DataFrame:
    """``SCORED`` rows of pairs (id_a, id_b): files, lines, which directions pass the overlap
    test, similarity. With ``overlap`` only pairs that pass it one way at least.
    Both inputs should be written tables.
    """
    checked_penalty(penalty)

    def score(some: pa.Table, blocks: pa.Table) -> pa.Table:
        known = Blocks(blocks)
        ids_a, ids_b = some.column("id_a").to_numpy(), some.column("id_b").to_numpy()
        at_a, at_b = known.places(ids_a), known.places(ids_b)
        ways = np.array([known.directions(i, j) for i, j in zip(at_a.tolist(), at_b.tolist())], bool).reshape(-1, 2)
        kept = np.flatnonzero(ways.any(1) if overlap else np.ones(len(ways), bool))
        at_a, at_b = at_a[kept], at_b[kept]
        similarity = np.array([known.cosine(i, j, penalty) for i, j in zip(at_a.tolist(), at_b.tolist())])
        columns = {"id_a": ids_a[kept], "id_b": ids_b[kept]}
        for s, at in (("a", at_a), ("b", at_b)):
            columns |= {f"{c}_{s}": known.table.column(c).take(pa.array(at)) for c in CARRIED}
        return pa.table(columns | {"ab": ways[kept, 0], "ba": ways[kept, 1], "similarity": similarity.astype(float)})

    return meeting(pairs.select("id_a", "id_b"), features.select("block_id", *CARRIED, "total", "keys", "counts", "head"), score, SCORED)
