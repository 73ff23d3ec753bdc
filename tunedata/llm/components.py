"""Connected components of an edge table by alternating stars, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(``u``, ``v``) with u > v: every node that is not the smallest of its component, and that smallest.

    Each round connects all neighbours of a node to the smallest (large star, then small
    star); the number of rounds grows with the logarithm of the longest path.  A node with very
    many neighbours is a pre-aggregated minimum and a join that may be split by key; neighbours
    are never collected.  Rounds are written to the shared folder.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(small.select("u", F.col("m").alias("v"))))
        now = staged(small.distinct(), "edges")
        before, state = state, _state(now)
    return now
