"""Connected components of an edge table by alternating star operations.

Large stars tie every larger neighbour of a node to its least neighbour, small
stars every smaller one; repeated in turn they end in one star per component.
Each round is a table in the shared folder, nothing is gathered on the driver
but two numbers that tell whether the round changed anything. A round's table is
deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import dropped, written


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = sides.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge but the roots, with its component's least node.

    ``edges`` has long columns u and v. Nulls, loops and repeated edges count for
    nothing; an empty table gives no rows.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    stamp = _stamp(now)
    while stamp[0]:
        old, now = now, written(_star(_star(now, True), False), "edges")
        dropped(edges.sparkSession, old)
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
