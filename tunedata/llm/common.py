"""Column helpers and shared-storage helpers of the text operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.session import scratch_dir

#: ASCII white space of the text contracts: space, tab, LF, VT, FF, CR
WS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(c, UPPER, UPPER.lower())


def lines_of(c: Column) -> Column:
    """Lines of a text; an empty text has one empty line."""
    return F.split(c, "\n", -1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def fan_out(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session (sized to the input by whoever runs it)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: lost executors re-read the files, and row ids or partition
    ids computed before the write stay as they are.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digits(n: int) -> int:
    return max(1, math.ceil(math.log2(max(n, 2))))
