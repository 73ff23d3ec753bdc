"""Experiment tracking in batch (X2-X9): history, progress, curves, best step, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import round4


def run_history(history: DataFrame, run_id: str | None = None) -> DataFrame:
    """Step metrics of one run (or all), in step order."""
    h = history if run_id is None else history.filter(F.col("run_id") == run_id)
    return h.orderBy("run_id", "step")


def job_progress(job_log: DataFrame, key: str = "job_id", version_col: str = "version") -> DataFrame:
    """Latest status per job and fraction = min(1, step / total), 0 when total = 0."""
    latest = job_log.groupBy(key).agg(
        F.max_by(F.struct("state", "step", "total_steps"), F.col(version_col)).alias("_l"))
    step, total = F.col("_l.step"), F.col("_l.total_steps")
    return latest.select(key, F.col("_l.state").alias("state"), step.alias("step"), total.alias("total_steps"),
                         F.when(total > 0, F.least(F.lit(1.0), step / total)).otherwise(0.0).alias("progress"))


def loss_curve(history: DataFrame) -> DataFrame:
    """Train curve = rows having loss; eval curve = rows with eval_loss > 0."""
    train = history.filter(F.col("loss").isNotNull()).select(
        "run_id", "step", F.lit("train").alias("series"), F.col("loss").alias("value"))
    ev = history.filter(F.col("eval_loss") > 0).select(
        "run_id", "step", F.lit("eval").alias("series"), F.col("eval_loss").alias("value"))
    return train.unionByName(ev)


def best_checkpoint(history: DataFrame) -> DataFrame:
    """Step with the lowest eval loss per run (ties -> lowest step)."""
    best = history.filter(F.col("eval_loss").isNotNull()).groupBy("run_id").agg(
        F.min(F.struct("eval_loss", "step")).alias("_b"))
    return best.select("run_id", F.col("_b.step").alias("best_step"), F.col("_b.eval_loss").alias("best_eval_loss"))


def last_value(history: DataFrame, value_col: str, key: str = "run_id") -> DataFrame:
    """(key, step, value) of the last step that has ``value_col`` (one aggregate, partial before the shuffle)."""
    last = history.filter(F.col(value_col).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct("step", value_col), "step").alias("_l"))
    return last.select(key, F.col("_l.step").alias("step"), F.col(f"_l.{value_col}").alias(value_col))


def final_metrics(history: DataFrame) -> DataFrame:
    """Last train loss and last eval loss per run (by step), side by side."""
    tr = last_value(history, "loss").select("run_id", F.col("step").alias("train_step"),
                                            F.col("loss").alias("train_loss"))
    ev = last_value(history, "eval_loss").select("run_id", F.col("step").alias("eval_step"), "eval_loss")
    return tr.join(ev, "run_id", "full")


def run_comparison(params: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters side by side (pivot over known keys) with final metrics."""
    wide = params.groupBy("run_id").pivot("key", keys).agg(F.first("value"))
    return wide.join(final_metrics(history), "run_id", "left")


def run_durations(history: DataFrame) -> DataFrame:
    """Start, end and duration (seconds) per run."""
    return history.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("completed_at")) \
        .withColumn("duration_s", (F.unix_micros(F.col("completed_at").cast("timestamp"))
                                   - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000000.0)


def run_metrics_merged(train: DataFrame, evaluation: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run; evaluation columns win where both sides have them."""
    shared = [c for c in evaluation.columns if c in train.columns and c != key]
    t = train.select(key, *[F.col(c).alias(f"_t_{c}") if c in shared else F.col(c)
                            for c in train.columns if c != key])
    j = t.join(evaluation, key, "full")
    for c in shared:
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_t_{c}"))).drop(f"_t_{c}")
    return j


def exact_mean(col: Column, scale: int = 4) -> tuple[Column, Column]:
    """Sum of a fixed-decimal value computed exactly (DECIMAL) and the count, for a stable mean."""
    return F.sum(col.cast(f"decimal(18,{scale})")), F.count(col)


def windowed_loss(history: DataFrame, window: str = "1 hour") -> DataFrame:
    """X9 batch form: rows and mean loss per run and event-time window."""
    s, n = exact_mean(F.col("loss"))
    w = F.window(F.col("ts").cast("timestamp"), window)
    g = history.groupBy("run_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), s.alias("_s"), n.alias("_n"))
    return finish_windowed(g)


def finish_windowed(g: DataFrame) -> DataFrame:
    return g.select("run_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("n_rows").cast("long").alias("n_rows"),
                    F.when(F.col("_n") > 0, round4(F.col("_s").cast("double") / F.col("_n"))).alias("avg_loss"))
