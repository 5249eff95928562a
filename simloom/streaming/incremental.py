"""New blocks against a standing corpus, as a stream of micro-batches.

Each batch of blocks is matched with the features kept so far and with itself;
the pairs that reach the threshold are appended to a table, and the batch's
features join the corpus. A repeated batch rewrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.config import Settings
from simloom.operators import candidates, features, score
from simloom.storage import written


def match_batch(corpus: str, pairs: str, settings: Settings) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over streams of blocks."""

    def step(blocks: DataFrame, batch: int) -> None:
        spark = blocks.sparkSession
        features.block_features(blocks).write.mode("overwrite").parquet(f"{corpus}/batch={batch}")
        kept = spark.read.parquet(corpus).where(F.col("batch") <= batch)
        own, before = kept.where(F.col("batch") == batch).drop("batch"), kept.where(F.col("batch") < batch).drop("batch")
        # Every block once; ids are unique over all batches.
        distance = settings.simhash_max_distance or candidates.MAX_DISTANCE
        new = candidates.paired(own, distance=distance).select("id_a", "id_b").unionByName(candidates.paired(own, before, distance=distance).select("id_a", "id_b"))
        scored = score.score_pairs(written(new, "pairs"), kept.drop("batch"), settings.frequency_penalty).drop("ab", "ba")
        found = scored.where((F.col("similarity") >= settings.threshold) & (F.col("file_a") != F.col("file_b")))
        found.write.mode("overwrite").parquet(f"{pairs}/batch={batch}")

    return step
