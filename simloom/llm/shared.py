"""Helpers that several operators share: places to write, Arrow slices, tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simloom.storage import dropped, fresh_path, read_table, shared_dir, written

__all__ = ["dropped", "fresh_path", "read_table", "shared_dir", "written"]

#: Bytes of text that one numpy step handles; bounds a worker's memory.
SLICE_BYTES = 2 << 20


#: Bytes of an Arrow batch sent to a Python worker. Spark's own bound is 64 MB, which each task
#: would hold several times: in the JVM, on the way and in the worker.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with the session's bound of a batch set where it names none."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


#: A bit field has 8 bits for each member at least, and at most 2^26 (8 MB).
LEAST_BITS, MOST_BITS = 20, 26


def field_bits(count: int, each: int = 8) -> int | None:
    """Bits (as a power of two) of a field for so many members, ``each`` for one where the bound
    allows; None where it does not even allow 8."""
    if max(LEAST_BITS, (8 * count).bit_length()) > MOST_BITS:
        return None
    return min(MOST_BITS, max(LEAST_BITS, (each * count).bit_length()))


def bit_field(slots: DataFrame, bits: int) -> np.ndarray:
    """A field of 2^bits bits with those of the one column of ``slots`` set."""
    named = slots.toDF("slot").where("slot IS NOT NULL")
    parts = named.groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
    field = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():  # at most 2048 rows of 4 KB
        field[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return field


def in_field(field: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((field[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


def release_memory() -> None:
    """Gives freed memory of a Python worker back to the system, where it can be."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and the path in it of a shared file."""
    if path.startswith("file:") or path.startswith("/"):
        plain = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    return fs.FileSystem.from_uri(path)


def slices(batches, column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose text has at most ``limit`` bytes.

    A single longer text makes a run of its own.
    """
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        start, rows = 0, batch.num_rows
        while start < rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(rows, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    dtype = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw_offsets, dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")
