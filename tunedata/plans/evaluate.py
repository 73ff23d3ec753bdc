"""The evaluation job as Spark jobs: readiness -> pick the split -> pair the
predictions -> score -> per-sample report -> append the result and the leaderboard entry.

Predictions come from a table (inference is outside this package).  The driver
reads only one-row answers (does the checkpoint exist, is the dataset READY,
the metric summary); samples, pairs and reports stay distributed.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.operators import catalog as R
from tunedata.operators import metrics as M
from tunedata.sources import files as S


class ModelNotFoundError(LookupError):
    """The checkpoint to evaluate is not registered."""


class DatasetNotReadyError(LookupError):
    """The dataset is missing or not READY."""


def load_eval_split(spark: SparkSession, processed_path: str) -> DataFrame:
    """The validation set if the dataset has one, else train; error if neither."""
    for name in ("validation", "train"):
        path = f"{processed_path.rstrip('/')}/split={name}"
        if S.path_exists(spark, path):                     # the other splits are neither listed nor read
            rows = spark.read.json(path)
            if rows.columns and not rows.isEmpty():
                return rows
    raise DatasetNotReadyError(f"no validation or train split under {processed_path}")


def evaluate(spark: SparkSession, evaluation_id: str, model_id: str, dataset_id: str, task_type: str,
             samples: DataFrame, predictions: DataFrame, checkpoints: DataFrame, datasets: DataFrame,
             results_path: str, benchmark_path: str, report_path: str) -> dict:
    """Score ``predictions`` (id, prediction) against ``samples`` (id, instruction, input, output)."""
    t0 = time.perf_counter()
    if checkpoints.filter(F.col("checkpoint_id") == model_id).limit(1).count() == 0:
        raise ModelNotFoundError(model_id)
    ds = datasets.filter(F.col("dataset_id") == dataset_id).select("lifecycle_state").first()
    if ds is None or ds["lifecycle_state"] != R.READY:
        raise DatasetNotReadyError(dataset_id)

    refs = samples.select("id", "instruction", "input", F.col("output").alias("reference"))
    pairs = M.pair_predictions(refs, predictions.select("id", "prediction"), ["id"]) \
        .withColumn("model_id", F.lit(model_id))
    if task_type == M.GENERATION:
        summary = M.generation_summary(pairs, ["model_id"], ["id", "model_id"])
    else:
        summary = M.classification_summary(pairs, ["model_id"])
    s = summary.first().asDict()

    # Per-sample report rows, written partitioned by evaluation id
    (pairs.select(F.lit(evaluation_id).alias("evaluation_id"), "id", "instruction", "input", "reference",
                  "prediction")
     .write.mode("append").partitionBy("evaluation_id").json(report_path))

    now = dt.datetime.now(dt.timezone.utc)
    primary = float((s["bleu"] if task_type == M.GENERATION else s["accuracy"]) or 0.0)     # E12
    metrics = {k: s[k] for k in M.METRIC_FIELDS}
    result = {"evaluation_id": evaluation_id, "model_id": model_id, "dataset_id": dataset_id,
              "task_type": task_type, **metrics, "runtime_seconds": round(time.perf_counter() - t0, 3),
              "report_path": f"{report_path}/evaluation_id={evaluation_id}", "created_at": now}
    schema = ("evaluation_id string, model_id string, dataset_id string, task_type string, "
              + ", ".join(f"{k} double" for k in M.METRIC_FIELDS)
              + ", runtime_seconds double, report_path string, created_at timestamp")
    spark.createDataFrame([result], schema).write.mode("append").parquet(results_path)
    metric_name = "bleu" if task_type == M.GENERATION else "accuracy"
    spark.createDataFrame([(f"{evaluation_id}:{metric_name}", dataset_id, model_id, metric_name, primary, now)],
                          "benchmark_id string, dataset_id string, model_id string, metric_name string, "
                          "metric_value double, evaluated_at timestamp") \
        .write.mode("append").parquet(benchmark_path)
    return result
