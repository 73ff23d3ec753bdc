"""Structured Streaming forms of experiment tracking (X1, X3, X9) and of the status overlay.

The reference rewrites a JSON file on every step and re-reads it on refresh.
Here the step metrics are a file stream.  Sinks write one folder per micro-batch, written again from scratch when the
batch is replayed; folder numbers go on when a sink gets a new checkpoint, so nothing is overwritten (``first_batch``).

* X1 appends rows and keeps no state; exact re-sends are removed on read.
* X3 and R12 keep state per job; changed rows leave as deltas that are folded into a snapshot every ``FOLD`` batches
  (``folding_sink``), so readers open one snapshot and fewer than ``FOLD`` deltas however long the stream has run.
* X9 bounds its state by an event-time watermark and still loses no row: a router sends rows that the watermark
  would drop to a side table, and the reader adds them (``windowed_loss_stream``).

The number of state partitions of a stateful query is taken from
``spark.sql.shuffle.partitions`` at its first start and then fixed by the
checkpoint: size it for the cluster before the first run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tunedata.operators.catalog import latest_per_key
from tunedata.operators.tracking import exact_mean, finish_windowed
from tunedata.session import scratch_dir
from tunedata.sources.files import path_exists

#: batches after which deltas are folded into a snapshot
FOLD = 16


def stage_files(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a batch of source files (how a training job would drop its step metrics)."""
    df.write.mode("append").format(fmt).save(path)


def stage_arrivals(df: DataFrame, path: str, arrivals: int = 4) -> None:
    """Write ``df`` as that many files, newest events first (each run spans several files)."""
    hour = F.hour("ts")
    for i in reversed(range(arrivals)):
        stage_files(df.filter(F.coalesce(hour, F.lit(0)) % arrivals == i).coalesce(1), path)


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.load(path)
    # event-time operators need TIMESTAMP (with time zone); the tables carry TIMESTAMP_NTZ
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(query_builder, timeout_s: int | None = None):
    """Process everything available now, then stop (``timeout_s`` None waits for the backlog)."""
    q = query_builder.trigger(availableNow=True).start()
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q


# ---------------------------------------------------------------------- sinks
def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``prefix=<number>`` below ``path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def first_batch(spark: SparkSession, sink: str, checkpoint: str) -> int:
    """Folder number of the checkpoint's batch 0: after all folders that the sink had when the checkpoint was new.

    Kept beside the checkpoint's own files, so a restart finds it again.
    """
    kept = f"{checkpoint}/sink-start"
    if not path_exists(spark, f"{kept}/_SUCCESS"):
        start = max(_folders(spark, sink, "batch"), default=-1) + 1
        spark.range(start, start + 1).coalesce(1).write.mode("overwrite").parquet(kept)
    return spark.read.schema("id long").parquet(kept).first().id


def _batch_folder(path: str, first: int, shape=lambda df: df):
    """foreachBatch sink: one folder per batch, written again from scratch when a batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={first + batch_id}")
    return write


def current_rows(spark: SparkSession, sink: str, schema: StructType, keys: list[str], order: list[str], upto: int | None = None) -> DataFrame:
    """Latest row per key of a ``folding_sink``: the last snapshot and the deltas after it."""
    snapshots = [n for n in _folders(spark, f"{sink}/snapshots", "upto") if upto is None or n < upto]
    base = max(snapshots, default=-1)
    paths = [f"{sink}/snapshots/upto={base}"] if snapshots else []
    paths += [f"{sink}/batch={n}" for n in _folders(spark, sink, "batch") if n > base and (upto is None or n <= upto)]
    if not paths:
        return spark.createDataFrame([], schema)
    return latest_per_key(spark.read.schema(schema).parquet(*paths), keys, order)


def folding_sink(spark: SparkSession, sink: str, first: int, keys: list[str], order: list[str], fold: int = FOLD):
    """foreachBatch sink of changed rows: a delta per batch, and after every ``fold`` batches a snapshot of the latest row per key.

    ``order`` must grow with every change of a key; then a replayed batch, or a whole stream that is run again, changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        n = first + batch_id
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")
        if (n + 1) % fold == 0:
            current_rows(spark, sink, batch.schema, keys, order, n).write.mode("overwrite").parquet(f"{sink}/snapshots/upto={n}")
    return write


# -------------------------------------------------------------------- streams
def append_dedup(spark: SparkSession, src: str, schema: StructType, sink: str, checkpoint: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Step metrics appended to a parquet table; exact re-sends are removed on read.

    No watermark: a row counts whenever it arrives, and no state is kept.  Two entries of one
    step that differ (train loss, eval loss) are both kept.
    """
    s = read_stream(spark, src, schema, max_files_per_trigger=max_files_per_trigger)
    first = first_batch(spark, sink, checkpoint)
    _run(s.writeStream.option("checkpointLocation", checkpoint).foreachBatch(_batch_folder(sink, first)))
    return (spark.read.schema(s.schema).parquet(sink).select(*s.columns).dropDuplicates()
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def latest_progress(spark: SparkSession, src: str, schema: StructType, sink: str, checkpoint: str,
                    key: str = "job_id", max_files_per_trigger: int | None = None, fold: int = FOLD) -> DataFrame:
    """X3 stream: latest status per job (state keyed by job only), update mode."""
    s = read_stream(spark, src, schema, max_files_per_trigger=max_files_per_trigger)
    agg = s.groupBy(key).agg(F.max_by(F.struct("state", "step", "total_steps"), F.col("version")).alias("_l"), F.max("version").alias("version"))
    sink_to = folding_sink(spark, sink, first_batch(spark, sink, checkpoint), [key], ["version"], fold)
    _run(agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink_to))
    latest = current_rows(spark, sink, agg.schema, [key], ["version"])
    step, total = F.col("_l.step"), F.col("_l.total_steps")
    return latest.select(key, F.col("_l.state").alias("state"), step.alias("step"), total.alias("total_steps"),
                         F.when(total > 0, F.least(F.lit(1.0), step / total)).otherwise(0.0).alias("progress"))


def live_overlay(spark: SparkSession, stored: DataFrame, src: str, schema: StructType, sink: str, checkpoint: str, key: str,
                 fields: list[str], version: str = "version", max_files_per_trigger: int | None = None, fold: int = FOLD) -> DataFrame:
    """R12 stream: stored status overlaid with live progress, by a stream-static join.

    Each micro-batch of progress rows meets the stored rows of its keys (Spark reads the stored table anew for each batch), and the rows overlaid
    leave as deltas; the latest of a key counts.  Keys without progress keep their stored row.  The same as ``status_overlay`` with the
    latest progress per key.  No stream state is kept.
    """
    s = read_stream(spark, src, schema, max_files_per_trigger=max_files_per_trigger)
    live = s.select(key, F.struct(*dict.fromkeys([version, *fields])).alias("_p")).where(F.col(key).isNotNull())
    joined = live.join(stored, key)
    overlaid = joined.select(F.col(key), F.col(f"_p.{version}").alias("_version"),
                             *[F.coalesce(F.col(f"_p.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns if c != key])
    first = first_batch(spark, sink, checkpoint)
    write = folding_sink(spark, sink, first, [key], ["_version"], fold)

    def newest(batch: DataFrame, batch_id: int) -> None:
        write(latest_per_key(batch, [key], ["_version"]), batch_id)
    _run(overlaid.writeStream.option("checkpointLocation", checkpoint).foreachBatch(newest))
    schema_out = latest_per_key(spark.createDataFrame([], overlaid.schema), [key], ["_version"]).schema
    now = current_rows(spark, sink, schema_out, [key], ["_version"]).drop("_version")
    rest = stored.join(now.select(key), key, "left_anti")
    return now.select(*stored.columns).unionByName(rest)


_ROW = "_row"


def route_late(spark: SparkSession, src: str, schema: StructType, sink: str, checkpoint: str, delay: str,
               max_files_per_trigger: int | None = None) -> StructType:
    """Split arrivals into ``sink/on_time`` and ``sink/late``; returns the schema of both.

    A row is late if its time is more than ``delay`` before the greatest time of all earlier batches.  That mark is written with every batch and
    read by the next, so a replayed batch is routed as before.  Rows get a digest of their content.
    """
    s = read_stream(spark, src, schema, max_files_per_trigger=max_files_per_trigger)
    s = s.withColumn(_ROW, F.md5(F.to_json(F.struct(*s.columns))))
    first = first_batch(spark, f"{sink}/marks", checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        n = first + batch_id
        earlier = [k for k in _folders(spark, f"{sink}/marks", "batch") if k < n]
        mark = spark.read.schema("high timestamp").parquet(f"{sink}/marks/batch={earlier[-1]}").first().high if earlier else None
        late = (F.col("ts") < F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")) if mark else F.lit(False)
        tagged = batch.withColumn("_late", F.coalesce(late, F.lit(False))).persist()
        for name, rows in (("on_time", tagged.where("not _late")), ("late", tagged.where("_late"))):
            rows.drop("_late").write.mode("overwrite").parquet(f"{sink}/{name}/batch={n}")
        high = tagged.agg(F.greatest(F.max("ts"), F.lit(mark).cast("timestamp")).alias("high"))
        high.coalesce(1).write.mode("overwrite").parquet(f"{sink}/marks/batch={n}")
        tagged.unpersist()
    _run(s.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write))
    return s.schema


def windowed_loss_stream(spark: SparkSession, src: str, schema: StructType, sink: str, checkpoint: str,
                         window: str = "1 hour", delay: str = "1 hour", max_files_per_trigger: int | None = None, fold: int = FOLD) -> DataFrame:
    """X9 stream: rows and mean loss per run and event-time window, each different row counted once, whenever it arrives.

    1. ``route_late`` puts rows more than ``delay`` behind into a side table.
    2. The others pass a stateful query: re-sends are dropped within the watermark (state: 16-byte digests of ``delay``), windows are
       aggregated, and both states end with the watermark.  Every routed row is ahead of the watermark; should the query ever drop one,
       it fails.
    3. The reader adds the side table's rows that don't repeat a row on time.
    """
    kept = route_late(spark, src, schema, sink, f"{checkpoint}/route", delay, max_files_per_trigger)
    total, n = exact_mean(F.col("loss"))
    sums = [F.count(F.lit(1)).alias("n_rows"), total.alias("_s"), n.alias("_n")]
    s = spark.readStream.schema(kept).parquet(f"{sink}/on_time/batch=*")
    once = s.withWatermark("ts", delay).dropDuplicatesWithinWatermark([_ROW])
    agg = once.groupBy("run_id", F.window("ts", window).alias("w")).agg(*sums)
    first = first_batch(spark, f"{sink}/windows", f"{checkpoint}/windows")
    keys = ["run_id", "w"]
    q = _run(agg.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/windows")
             .foreachBatch(folding_sink(spark, f"{sink}/windows", first, keys, ["n_rows"], fold)))
    lost = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", []))
    if lost:
        raise RuntimeError(f"the watermark dropped {lost} rows that were routed as on time")
    windows = current_rows(spark, f"{sink}/windows", agg.schema, keys, ["n_rows"])
    late = spark.read.schema(kept).parquet(f"{sink}/late").select(*kept.fieldNames()).dropDuplicates([_ROW])
    on_time = spark.read.schema(kept).parquet(f"{sink}/on_time").select(_ROW)
    missed = late.join(on_time, _ROW, "left_anti").groupBy("run_id", F.window("ts", window).alias("w")).agg(*sums)
    both = windows.select(*missed.columns).unionByName(missed).groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return finish_windowed(both)


def workdir(spark: SparkSession, name: str) -> dict[str, str]:
    base = scratch_dir(spark, name)
    return {"src": f"{base}/src", "sink": f"{base}/sink", "checkpoint": f"{base}/checkpoint"}
