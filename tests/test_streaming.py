"""Streaming results equal the batch results over the same files."""

from pyspark.sql import functions as F

from tunedata.operators import tracking as T
from tunedata.plans import fixtures as X
from tunedata.streaming import tracking as S

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    h = X.metric_history(spark, SF_SMALL)
    w = S.workdir(spark, "t-append")
    # one file per micro-batch, newest first, then a re-sent slice and a second entry of some steps
    S.stage_arrivals(h, w["src"])
    again = h.filter((F.col("step") < 5) & F.col("loss").isNotNull())
    S.stage_files(again.coalesce(1), w["src"])
    S.stage_files(again.withColumn("loss", F.col("loss") + 1).coalesce(1), w["src"])
    out = S.append_dedup(spark, w["src"], h.schema, w["sink"], w["checkpoint"], max_files_per_trigger=1)
    assert out.count() == h.count() + again.count() and out.exceptAll(h).count() == again.count()

    w2 = S.workdir(spark, "t-window")
    S.stage_arrivals(h, w2["src"], 5)
    stream = S.windowed_loss_stream(spark, w2["src"], h.schema, w2["sink"], w2["checkpoint"], max_files_per_trigger=1)
    assert sorted(stream.collect()) == sorted(T.windowed_loss(h).collect())

    log = X.job_log(spark, SF_SMALL)
    w3 = S.workdir(spark, "t-progress")
    S.stage_files(log, w3["src"])
    prog = S.latest_progress(spark, w3["src"], log.schema, w3["sink"], w3["checkpoint"])
    assert sorted(prog.collect()) == sorted(T.job_progress(log).collect())


def test_a_new_checkpoint_overwrites_nothing(spark):
    h = X.metric_history(spark, SF_SMALL)
    half = F.col("event_id") % 2 == 0
    w = S.workdir(spark, "t-restart")
    S.stage_files(h.filter(half).coalesce(1), w["src"] + "/a")
    S.stage_files(h.filter(~half).coalesce(1), w["src"] + "/b")
    S.append_dedup(spark, w["src"] + "/a", h.schema, w["sink"], w["checkpoint"])
    out = S.append_dedup(spark, w["src"] + "/b", h.schema, w["sink"], w["checkpoint"] + "-new")
    assert sorted(out.collect(), key=repr) == sorted(h.collect(), key=repr)
    again = S.append_dedup(spark, w["src"] + "/b", h.schema, w["sink"], w["checkpoint"] + "-new")          # nothing new
    assert again.count() == h.count() and S._folders(spark, w["sink"], "batch") == [0, 1]


def test_window_stream_counts_late_and_resent_rows_once(spark):
    h = X.metric_history(spark, SF_SMALL)
    w = S.workdir(spark, "t-late")
    S.stage_arrivals(h, w["src"], 4)
    S.stage_files(h.filter("event_id % 3 = 0").coalesce(1), w["src"])
    want = sorted(T.windowed_loss(h).collect(), key=repr)
    args = (spark, w["src"], h.schema, w["sink"])
    out = S.windowed_loss_stream(*args, w["checkpoint"], delay="2 hours", max_files_per_trigger=1, fold=2)
    assert sorted(out.collect(), key=repr) == want
    late = spark.read.parquet(w["sink"] + "/late")
    on_time = spark.read.parquet(w["sink"] + "/on_time")
    # arrivals: hours 3, 2, 1, 0 modulo 4 of all days; a row is late if it is 2 hours behind all files before its own
    high, rows = None, []
    for i in (3, 2, 1, 0, None):
        part = h.filter(F.hour("ts") % 4 == i if i is not None else "event_id % 3 = 0").select("ts", "event_id").collect()
        rows += [r.event_id for r in part if high and (high - r.ts).total_seconds() > 7200]
        high = max([r.ts for r in part] + ([high] if high else []))
    assert sorted(r.event_id for r in late.select("event_id").collect()) == sorted(rows) and len(rows) > h.count() / 2
    assert late.count() + on_time.count() == h.count() + h.filter("event_id % 3 = 0").count()
    # later arrivals on the same checkpoints, then the whole stream again with new ones
    S.stage_files(h.filter("event_id % 5 = 0").withColumn("loss", F.col("loss") + 1).coalesce(1), w["src"])
    more = h.unionByName(h.filter("event_id % 5 = 0").withColumn("loss", F.col("loss") + 1)).dropDuplicates()
    want = sorted(T.windowed_loss(more).collect(), key=repr)
    assert sorted(S.windowed_loss_stream(*args, w["checkpoint"], delay="2 hours", max_files_per_trigger=1, fold=2).collect(), key=repr) == want
    assert sorted(S.windowed_loss_stream(*args, w["checkpoint"] + "-new", delay="2 hours", max_files_per_trigger=2).collect(), key=repr) == want


def test_progress_reads_a_snapshot_and_few_deltas(spark):
    log = X.job_log(spark, SF_SMALL)
    w = S.workdir(spark, "t-fold")
    for i in range(7):
        S.stage_files(log.filter(F.col("version") % 7 == i).coalesce(1), w["src"])
    args = (spark, w["src"], log.schema, w["sink"])
    want = sorted(T.job_progress(log).collect())
    assert sorted(S.latest_progress(*args, w["checkpoint"], max_files_per_trigger=1, fold=3).collect()) == want
    assert S._folders(spark, w["sink"] + "/snapshots", "upto") == [2, 5] and S._folders(spark, w["sink"], "batch") == list(range(7))
    assert sorted(S.latest_progress(*args, w["checkpoint"] + "-new", max_files_per_trigger=3, fold=3).collect()) == want


def test_live_overlay_equals_batch_overlay(spark):
    from tunedata.operators.catalog import latest_per_key, status_overlay
    log = X.job_log(spark, SF_SMALL).select("job_id", "version", "ts", "state", "step")
    stored = log.groupBy("job_id").agg(F.lit("pending").alias("state"), F.lit(0).alias("step"), F.max("ts").alias("created"))
    stored = stored.unionByName(stored.limit(1).withColumn("job_id", F.lit("idle")))
    w = S.workdir(spark, "t-overlay")
    gaps = log.withColumn("step", F.when(F.col("version") % 3 > 0, F.col("step")))
    for i in range(3):
        S.stage_files(gaps.filter(F.col("version") % 3 == i).coalesce(1), w["src"])
    live = S.live_overlay(spark, stored, w["src"], gaps.schema, w["sink"], w["checkpoint"], "job_id", ["state", "step"], max_files_per_trigger=1, fold=2)
    batch = status_overlay(stored, latest_per_key(gaps, ["job_id"], ["version"]), "job_id", ["state", "step"])
    assert sorted(live.collect()) == sorted(batch.select(*live.columns).collect())
