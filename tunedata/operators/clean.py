"""Cleaning (C1-C7): column mapping, null drop, strip, keyed de-duplication, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import ustrip
from tunedata.operators.validate import require_columns


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Logical name -> physical column (``instruction``, ``input``, ``output``)."""
    mapping = mapping or {}
    inst, inp, out = (mapping.get(k, k) for k in ("instruction", "input", "output"))
    require_columns(df, [inst, out])  # V8
    keep = [c for c in df.columns if c not in (inst, inp, out)]
    return df.select(*keep, F.col(inst).alias("instruction"),
                     (F.col(inp) if inp in df.columns else F.lit(None).cast("string")).alias("input"),
                     F.col(out).alias("output"))


def drop_null(df: DataFrame, cols=("instruction", "output")) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (before stripping, as the reference does)."""
    return df.na.drop(subset=list(cols))


def strip_fields(df: DataFrame) -> DataFrame:
    """Cast to string and strip; missing input becomes ''."""
    return (df.withColumn("instruction", ustrip(F.col("instruction").cast("string")))
              .withColumn("output", ustrip(F.col("output").cast("string")))
              .withColumn("input", ustrip(F.coalesce(F.col("input").cast("string"), F.lit("")))))


def key_hash(keys) -> Column:
    """16 bytes that stand for the combination of ``keys``."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(k).alias(k) for k in keys]))))


def dedup_keep_first(df: DataFrame, keys=("instruction", "output", "input"), order_col: str = "id") -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every key combination.

    The keys are hashed to 16 bytes and ``min(order_col)`` is aggregated per
    hash with map-side partial aggregation, so a key repeated in a third of the
    table collapses before the shuffle and the wide text never moves; the
    survivors are picked with a semi-join on the (unique) order column.
    """
    firsts = df.select(key_hash(keys).alias("_kh"), order_col).groupBy("_kh").agg(F.min(order_col).alias(order_col))
    return df.join(firsts.select(order_col), order_col, "left_semi")


def clean_instructions(df: DataFrame, mapping: dict[str, str] | None = None,
                       order_col: str = "id") -> DataFrame:
    """C1 -> C2 -> C3/C4 -> C5."""
    return dedup_keep_first(strip_fields(drop_null(map_columns(df, mapping))), order_col=order_col)


def cleaning_funnel(df: DataFrame, test_size: float = 0.2, keys=("instruction", "output", "input")) -> DataFrame:
    """Initial, null-free, duplicates removed, final, train and validation sizes, from one read.

    Rows are counted per key hash (null: a row that C2 drops) with partial aggregation; the final
    rows are the hashes that occur, so no row is joined back.
    Validation size follows the two-way split rule ceil(test_size * n).
    """
    m = map_columns(df)
    whole = F.col("instruction").isNotNull() & F.col("output").isNotNull()
    flagged = strip_fields(m.withColumn("_nn", whole)).select(F.when(F.col("_nn"), key_hash(keys)).alias("_kh"))
    agg = flagged.groupBy("_kh").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("initial_rows"),
        F.coalesce(F.sum(F.when(F.col("_kh").isNotNull(), F.col("_n"))), F.lit(0)).alias("null_free_rows"),
        F.count("_kh").alias("final_rows"))
    val = F.ceil(F.lit(test_size) * F.col("final_rows")).cast("long")
    return agg.select(
        "initial_rows", "null_free_rows",
        (F.col("null_free_rows") - F.col("final_rows")).alias("duplicates_removed"),
        "final_rows", (F.col("final_rows") - val).alias("train_rows"), val.alias("validation_rows"))
