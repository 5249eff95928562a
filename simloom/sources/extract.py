"""Blocks of source files by a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import paths
from simloom.sources.lexer import find_blocks

BLOCKS = "ordinal int, kind string, start_line int, end_line int, tokens array<string>"


class ExtractBlocks:
    """(language, text, min_tokens) to a row per block."""

    def eval(self, language: str, text: str, min_tokens: int) -> Iterator[tuple]:
        for i, b in enumerate(find_blocks(text or "", language or "", min_tokens)):
            yield i, b.kind, b.start_line, b.end_line, list(b.tokens)


def extract_blocks(sources: DataFrame, min_tokens: int = 3) -> DataFrame:
    """Blocks of ``sources`` (file, text): id, file, kind, lines and tokens.

    The id follows file and place, so it is the same in every run.
    """
    spark: SparkSession = sources.sparkSession
    table = F.udtf(ExtractBlocks, returnType=BLOCKS)
    spark.udtf.register("simloom_extract_blocks", table)
    named = sources.select("file", "text", paths.language(F.col("file")).alias("language")).where("language IS NOT NULL")
    found = spark.sql(
        f"SELECT s.file, b.* FROM {{sources}} s, LATERAL simloom_extract_blocks(s.language, s.text, {int(min_tokens)}) b", sources=named
    )
    return found.withColumn("block_id", F.xxhash64("file", "ordinal"))
