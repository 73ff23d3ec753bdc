"""Dataset profile (P1-P8): one scan for every sum plus one fingerprint shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import estimate_tokens, is_missing, round2, ustrip
from tunedata.operators.validate import REQUIRED_FIELDS, ERROR, _col_or_null, fingerprint_stats, issue_array, issues_of


def _text(df: DataFrame, name: str) -> Column:
    """The value as text; missing, zero and false values are '' (as ``str(value or "")``)."""
    if name not in df.columns:
        return F.lit("")
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        c = F.when(c, c)
    elif isinstance(kind, T.NumericType):
        c = F.when(c != 0, c)
    return F.coalesce(c.cast("string"), F.lit(""))


def prompt_text(df: DataFrame) -> Column:
    """``f"{instruction} {input}".strip()``."""
    return ustrip(F.concat(_text(df, "instruction"), F.lit(" "), _text(df, "input")))


def response_text(df: DataFrame) -> Column:
    return _text(df, "output")


def profile(df: DataFrame, dataset_col: str | None = None) -> DataFrame:
    """Rows, sorted columns, duplicates, mean lengths (2 dp), token estimate.

    One scan and one fingerprint pipeline (``fingerprint_stats``) for every
    number.  Empty input gives the all-zero profile (P7) through ``coalesce``.
    """
    g = dataset_col or "_ds"
    columns = ",".join(sorted(c for c in df.columns if c != dataset_col))
    p, r = prompt_text(df), response_text(df)
    st = fingerprint_stats(df, dataset_col, {
        "_pc": F.length(p).cast("long"), "_rc": F.length(r).cast("long"),
        "_tok": (estimate_tokens(p) + estimate_tokens(r)).cast("long")})
    n = F.col("n_rows")
    out = st.select(
        g, n.alias("rows_count"), F.lit(columns).alias("columns"),
        F.coalesce(F.col("duplicate_count"), F.lit(0)).cast("long").alias("duplicate_count"),
        F.when(n > 0, round2(F.col("_pc").cast("double") / n)).otherwise(0.0).alias("avg_prompt_length"),
        F.when(n > 0, round2(F.col("_rc").cast("double") / n)).otherwise(0.0).alias("avg_response_length"),
        F.coalesce(F.col("_tok"), F.lit(0)).cast("long").alias("estimated_tokens"))
    return out.drop("_ds") if dataset_col is None else out


def profile_missing(df: DataFrame, dataset_col: str | None = None) -> DataFrame:
    """Null-or-blank count for every column, as (column, missing) rows."""
    g = dataset_col or "_ds"
    d = df if dataset_col else df.withColumn("_ds", F.lit("dataset"))
    cols = sorted(c for c in df.columns if c != dataset_col)
    wide = d.groupBy(g).agg(*[F.count_if(is_missing(c)).cast("long").alias(c) for c in cols])
    stacked = wide.select(g, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])).alias("_m"))
    out = stacked.select(g, "_m.column", "_m.missing")
    return out.drop("_ds") if dataset_col is None else out


def profile_lengths(df: DataFrame, dataset_col: str | None = None) -> DataFrame:
    """Mean stripped prompt length and mean response length (2 dp)."""
    keys = [dataset_col] if dataset_col else []
    p, r = prompt_text(df), response_text(df)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_count"),
        round2(F.sum(F.length(p)).cast("double") / F.count(F.lit(1))).alias("avg_prompt_length"),
        round2(F.sum(F.length(r)).cast("double") / F.count(F.lit(1))).alias("avg_response_length"))


def audit_and_profile(df: DataFrame, dataset_col: str) -> DataFrame:
    """V6 + P8 for every dataset from ONE fingerprint pipeline (one scan, one shuffle of 16-byte
    fingerprints): missing counts, duplicates, validity, lengths and token estimate together."""
    p, r = prompt_text(df), response_text(df)
    flags = {f"missing_{c}": is_missing(_col_or_null(df, c)).cast("long") for c in ("instruction", "output", "input")}
    st = fingerprint_stats(df, dataset_col, {
        **flags, "_pc": F.length(p).cast("long"), "_rc": F.length(r).cast("long"),
        "_tok": (estimate_tokens(p) + estimate_tokens(r)).cast("long")})
    present = set(df.columns)
    counts = st.select("*", *[F.lit(f in present).alias(f"has_{f}") for f in REQUIRED_FIELDS])
    n = F.col("n_rows")
    return counts.withColumn("issues", issue_array()).select(
        dataset_col, (issues_of(ERROR) == 0).alias("is_valid"),
        n.alias("rows_count"), F.col("duplicate_count"),
        *[F.col(c).cast("long").alias(c) for c in flags],
        F.when(n > 0, round2(F.col("_pc").cast("double") / n)).otherwise(0.0).alias("avg_prompt_length"),
        F.when(n > 0, round2(F.col("_rc").cast("double") / n)).otherwise(0.0).alias("avg_response_length"),
        F.col("_tok").cast("long").alias("estimated_tokens"))
