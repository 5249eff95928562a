"""Line dedup: drop lines that many documents share, but for one document.

Native: DataFrame functions only. The lines become rows of 128-bit hashes, written
once. They are range-partitioned by hash and sorted within a partition by
document (largest first), row and position; a window streams over that order:
the first row of a hash's run holds its first occurrence, whose document keeps
the line, and each change of document counts one more that holds it.

Hashes too frequent for one range are found by a sketch of frequent items, at
most 8 for each shuffle partition. Their occurrences are spread by document
instead, reduced to one decision for each hash before a shuffle, and the
decisions, bounded in number, are broadcast. The sketch only chooses the way:
both ways are exact.

What goes back to the documents is a compressed bitmap of the lines to keep, never
text: of its 64-bit words only those that miss a line are held (bits beyond the
last line are set).

Results for odd input: a null or empty text is one empty line and stays; rows
with the same id count as one document; rows with a null id count together as
one document ranked below every id; of lines that tie in a document all stay or
all go; equal rows get equal results; a very long text is one row of many lines
and its bitmap grows with them; empty tables give no rows. Extra columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.shared import session_partitions, written

#: Stripped at both ends of a line before lines are compared.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id; ranks below every other.
NO_ID = -(2**63)

MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: A hash is hot from this share of the mean partition on.
HOT_PARTS = 8
#: Most items that Spark's sketch tracks.
MOST_TRACKED = 1_000_000
ROW = ["doc", "t1", "t2"]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Names a row: its id, and a hash that tells apart texts that share an id."""
    return [
        F.coalesce(id_col.cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(7), text).alias("t2"),
    ]


def _text(text_col: str) -> Column:
    return F.coalesce(column(text_col), F.lit(""))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row per line long enough: hash, row and position."""
    text = _text(text_col)
    lines = docs.select(*row_key(column(id_col), text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    return lines.where(F.char_length(key) >= min_chars).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), *ROW, "pos")


def hot_hashes(hashes: DataFrame) -> DataFrame:
    """(h1) of the hashes that would fill much of a partition: at most ``HOT_PARTS`` for each."""
    spark = hashes.sparkSession
    most = HOT_PARTS * session_partitions(spark)
    tracked = min(MOST_TRACKED, max(10_000, 8 * most))
    top = F.expr(f"approx_top_k(h1, {min(most, tracked)}, {tracked})")
    n, items = hashes.agg(F.count(F.lit(1)), top).first()
    return spark.createDataFrame([(x["item"],) for x in items or () if x["count"] * most > n], "h1 long")


def streamed(hashes: DataFrame, min_documents: int) -> DataFrame:
    """(row, pos) of lines that go, decided along ranges sorted by hash, document and position."""
    run = Window.partitionBy("h1", "h2")
    order = run.orderBy(F.desc("doc"), "t1", "t2", "pos")
    before = F.lag("doc").over(order)
    seen = hashes.repartitionByRange("h1", "h2").select(
        "h1", "h2", *ROW, "pos", F.first("doc").over(order).alias("keep"), F.when(before.eqNullSafe(F.col("doc")), 0).otherwise(1).alias("new")
    )
    return seen.withColumn("n", F.sum("new").over(run)).where((F.col("n") >= min_documents) & (F.col("doc") != F.col("keep"))).select(*ROW, "pos")


def decided(hashes: DataFrame, min_documents: int) -> DataFrame:
    """The same for hot hashes: occurrences spread by document, one decision for each hash."""
    once = hashes.select("h1", "h2", "doc").distinct()
    keep = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keep")).where(F.col("n") >= min_documents)
    return hashes.join(F.broadcast(keep.select("h1", "h2", "keep")), ["h1", "h2"]).where("doc <> keep").select(*ROW, "pos")


def keep_bitmaps(hashes: DataFrame, min_documents: int) -> DataFrame:
    """For each row that loses lines: map from word number to the bits of the lines to keep."""
    hot = hot_hashes(hashes)
    gone = streamed(hashes.join(F.broadcast(hot), "h1", "left_anti"), min_documents)
    gone = gone.unionByName(decided(hashes.join(F.broadcast(hot), "h1", "left_semi"), min_documents))
    words = gone.groupBy(*ROW, F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    entry = F.struct("word", F.bitwise_not("bits"))
    return words.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(entry)).alias("keep"), F.max("word").alias("last"))


def _rows_with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    """(row, keep, words): each row of ``docs`` whole, and its bitmap as map and as array.

    Both are null for a row that keeps all lines; the array lets a line find its
    word at once.
    """
    hashes = written(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    full = F.lit(-1).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.element_at("keep", w), full))
    bitmaps = keep_bitmaps(hashes, min_documents).select(*ROW, "keep", words.alias("words"))
    keyed = docs.select(F.struct(*map(column, docs.columns)).alias("row"), *row_key(column(id_col), _text(text_col)))
    return keyed.join(bitmaps, ROW, "left").select("row", "keep", "words")


def kept_text(text: Column) -> Column:
    """The lines of ``text`` that the bitmap in ``words`` keeps."""
    word = lambda i: F.coalesce(F.get("words", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: F.getbit(word(i), i % 64) == 1)
    return F.when(F.col("words").isNull(), text).otherwise(F.array_join(kept, "\n"))


def n_gone() -> Column:
    counted = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(F.bitwise_not(w)))
    return F.coalesce(counted, F.lit(0).cast("long"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with the kept lines as text; other columns as they were."""
    found = _rows_with_bitmaps(docs, id_col, text_col, min_chars, min_documents)
    old = lambda c: F.col("row")[c]
    new = F.when(F.col("words").isNull(), old(text_col)).otherwise(kept_text(old(text_col)))
    return found.select(*((new if c == text_col else old(c)).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """A row per document: lines before, lines dropped, hash of the kept text, bitmap.

    ``kept_words`` is the compressed bitmap as ``word:hex`` entries in order.
    """
    few = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    found = _rows_with_bitmaps(few, "doc_id", "text", min_chars, min_documents)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    entries = F.transform(F.array_sort(F.map_entries("keep")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.lower(F.hex(e["value"]))))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        n_gone().alias("n_dropped"),
        F.sha2(kept_text(text), 256).alias("kept_sha256"),
        F.coalesce(F.array_join(entries, ","), F.lit("")).alias("kept_words"),
    )
