"""Source files: discovery on the driver, reading on the executors."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.config import Settings
from simloom.errors import PathNotFoundError
from simloom.functions import paths

log = logging.getLogger("simloom")

SOURCE = "file string, text string"


def discover(roots: Iterable[str], settings: Settings) -> list[str]:
    """Files below the roots, sorted per root; overlapping roots give repeats.

    A root that is a file needs a known extension only. In folders, entries that
    begin with a dot are left out (never a root itself), links to folders are not
    followed, and ignore patterns and the size limit apply.
    """
    wanted = {e.lower() for e in settings.extensions}
    known = lambda p: os.path.splitext(p)[1][1:].lower() in wanted
    out: list[str] = []
    for root in roots:
        if os.path.isfile(root):
            out += [root] * known(root)
        elif os.path.isdir(root):
            for folder, names, files in os.walk(root, followlinks=False):
                names[:] = sorted(n for n in names if not n.startswith("."))
                for name in sorted(files):
                    path = os.path.join(folder, name)
                    if name.startswith(".") or os.path.islink(path) and not os.path.isfile(path) or not known(name):
                        continue
                    if paths.is_ignored(path, settings.ignore, settings.glob_mode):
                        continue
                    if os.path.getsize(path) > settings.max_file_size:
                        log.warning("%s is larger than %d bytes", path, settings.max_file_size)
                        continue
                    out.append(path)
        else:
            raise PathNotFoundError(f"no such path: {root}")
    return out


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, text) of the files that are UTF-8; the others give no row."""
    if not files:
        return spark.createDataFrame([], SOURCE)
    absolute = [os.path.abspath(f) for f in files]
    given = spark.createDataFrame(list(zip(absolute, files)), "path string, file string")
    raw = spark.read.format("binaryFile").load(list(dict.fromkeys(absolute)))
    plain = F.regexp_replace("path", r"^file:/*", "/")
    good = raw.where(F.is_valid_utf8(F.col("content").cast("string"))).select(plain.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return good.join(given, "path").select("file", "text")


def read_folder(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    """(file, text) below a folder of any store; predicates run before contents are read.

    For very many files: the listing is Spark's own, size and path filters are
    pushed to the scan, and names are not brought to the driver.
    """
    root = folder.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.substring_index(F.col("path"), re.sub(r"^file:/*", "/", root).rstrip("/") + "/", -1)
    chosen = raw.where(F.col("length") <= settings.max_file_size).withColumn("file", inner)
    chosen = chosen.where(paths.supported(F.col("file"), settings.extensions) & ~paths.hidden(F.col("file")))
    chosen = chosen.where(~paths.ignored(F.col("file"), settings.ignore, settings.glob_mode))
    return chosen.where(F.is_valid_utf8(F.col("content").cast("string"))).select("file", F.decode("content", "UTF-8").alias("text"))


def source_lines(sources: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions`` (file, start_line, end_line) with ``lines``, the text of those lines."""
    lines = F.split(F.col("text"), r"\r?\n", -1)
    joined = regions.join(sources, "file", "left")
    part = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return joined.withColumn("lines", part).drop("text")
