"""Leaderboard and performance comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunedata.functions.text import round2, round4
from tunedata.plans.ordered import rank_by_counting

# Fallbacks used when a model has no registered checkpoint.
UNKNOWN_BASE = "N/A"
NAME_PREFIX = "checkpoint-"


def enrich(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """L2: checkpoint name (or ``checkpoint-<first 8 of id>``) and base model (or N/A).

    One equi-join replaces the reference's lookup per entry; Catalyst/AQE
    broadcast the checkpoint side only when its measured size is small.
    """
    ck = checkpoints.select(F.col("checkpoint_id").alias("model_id"), "model_name", "base_model")
    j = entries.join(ck, "model_id", "left")
    return (j.withColumn("model_name", F.coalesce(F.col("model_name"),
                                                  F.concat(F.lit(NAME_PREFIX), F.substring("model_id", 1, 8))))
             .withColumn("base_model", F.coalesce(F.col("base_model"), F.lit(UNKNOWN_BASE))))


def normalise(entries: DataFrame) -> DataFrame:
    """L3: metric name upper-cased, value rounded to 4 dp (raw kept for tie order)."""
    return (entries.withColumn("metric_raw", F.col("metric_value"))
                   .withColumn("metric_name", F.upper("metric_name"))
                   .withColumn("metric_value", round4("metric_value")))


def best_per_model(entries: DataFrame, group: list[str]) -> DataFrame:
    """L4: best run per model (per ``group``): rounded desc, raw desc, benchmark_id.

    ``min_by`` over an ordering struct is an aggregate with map-side partial
    aggregation, so a model with a third of all runs is reduced before the shuffle.
    """
    cols = [c for c in entries.columns if c not in group]
    order = F.struct((-F.col("metric_value")).alias("a"), (-F.col("metric_raw")).alias("b"),
                     F.col("benchmark_id").alias("c"))
    best = entries.groupBy(*group).agg(F.min_by(F.struct(*cols), order).alias("_b"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in cols])


def leaderboard(entries: DataFrame, checkpoints: DataFrame, per_metric: bool = False,
                top_k: int | None = None) -> DataFrame:
    """All datasets at once; models ranked per dataset (metrics mixed unless ``per_metric``)."""
    part = ["dataset_id", "metric_name"] if per_metric else ["dataset_id"]
    best = best_per_model(normalise(entries), part + ["model_id"])
    if top_k is not None:       # Spark trims every partition to the first k before the shuffle
        w = Window.partitionBy(*part).orderBy(F.col("metric_value").desc(), F.col("metric_raw").desc(), "model_id")
        ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).withColumn("rank", F.col("rank").cast("long"))
    else:
        # by rounded value, then raw value and the first characters of the id, then the id
        keyed = best.withColumns({"_nv": -F.col("metric_value"), "_nr": -F.col("metric_raw"), "_id": F.substring("model_id", 1, 6)})
        ranked = rank_by_counting(keyed, part, [["_nv"], ["_nr", "_id"]], ["model_id"], "rank").drop("_nv", "_nr", "_id")
    return enrich(ranked, checkpoints).select(
        *part, "rank", "model_id", "model_name", "base_model",
        *([] if per_metric else ["metric_name"]), "metric_value", "evaluated_at")


def perf_matrix(log: DataFrame, hourly_cost: float, group=("model_id",)) -> DataFrame:
    """Mean latency, tokens/s (sum/sum), and cost per 1M tokens at an hourly rate."""
    lat = F.sum(F.col("latency_ms").cast("double"))
    tps = F.sum(F.col("tokens").cast("double")) / (lat / 1000)
    aggs = [round2(F.avg(F.col("latency_ms").cast("double"))).alias("avg_latency_ms"),
            round2(tps).alias("tokens_per_sec"),
            round4(F.lit(hourly_cost) / 3600 / tps * 1000000).alias("cost_per_1m_tokens")]
    if "peak_memory_mb" in log.columns:
        aggs.append(F.max("peak_memory_mb").alias("peak_memory_mb"))
    return log.groupBy(*group).agg(*aggs)


def throughput_by_batch(log: DataFrame, group=("model_id",)) -> DataFrame:
    """tokens/s per (model, batch size)."""
    lat = F.sum(F.col("latency_ms").cast("double"))
    return log.groupBy(*group, "batch_size").agg(
        round2(F.sum(F.col("tokens").cast("double")) / (lat / 1000)).alias("tokens_per_sec"))


def throughput_pivot(log: DataFrame, batch_sizes: list[int], group=("model_id",)) -> DataFrame:
    """L7 pivot view: one column per batch size (values listed, so no extra distinct job)."""
    t = throughput_by_batch(log, group)
    return t.groupBy(*group).pivot("batch_size", batch_sizes).agg(F.first("tokens_per_sec")) \
        .select(*group, *[F.col(str(b)).alias(f"bs{b}") for b in batch_sizes])
