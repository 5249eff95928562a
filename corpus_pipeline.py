"""A corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again for the next. All stages but the
last return the columns of ``documents``.

Results for odd input: a null or empty text, or one without a letter, has no
language and goes in the first stage; where no language can be learned (no row
with one) all texts with a letter stay. Rows with a null id stay as long as their
text does; repeated rows count as copies, of which the near-duplicate stage keeps
those that bear the least id. Very long texts pass every stage whole. Extra
columns, whatever their names, go along up to the last stage. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from simloom.llm.queries import tokenizer_file
from simloom.llm.shared import documents, dropped, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; the network learns from these documents."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the one with the largest id."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id stays."""
    return ngram_join.keep_first_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.bpe_report(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("bpe", encode_bpe),
]

#: Language ID and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
