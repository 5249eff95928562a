"""Tables: reading them, and writing intermediate ones to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than cores and at most so many bytes is dealt over the cores when read.
SPREAD_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) a
    temporary folder is made and set, so that later calls agree.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='simloom-')}")
        return spark.sparkContext.getCheckpointDir()
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables made by ``written``, or folders, that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``; a small one of few files is dealt over all cores.

    A Parquet file of one row group is one task otherwise, whatever follows.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
    if found.getFileCount() < cores and 1 << 20 < found.getLength() <= SPREAD_BYTES:
        return df.repartition(cores)
    return df
