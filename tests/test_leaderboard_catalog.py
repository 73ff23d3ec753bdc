"""Leaderboard (reference case, tie rule) and catalog operators."""

import datetime as dt

from pyspark.sql import functions as F

from tunedata.operators import catalog as R
from tunedata.operators import leaderboard as L

BENCH = "benchmark_id string, dataset_id string, model_id string, metric_name string, metric_value double, " \
        "evaluated_at string"
CKPT = "checkpoint_id string, model_name string, base_model string"


def test_reference_leaderboard_case(spark):
    bench = spark.createDataFrame([
        ("b1", "ds", "model_uuid_1", "bleu", 0.82, "2026-07-17T12:00:00"),
        ("b2", "ds", "model_uuid_2", "bleu", 0.94, "2026-07-17T12:30:00"),
        ("b3", "ds", "model_uuid_1", "bleu", 0.75, "2026-07-16T12:00:00")], BENCH)
    ck = spark.createDataFrame([("model_uuid_1", "llama-fine-tuned-1", "llama-8b"),
                                ("model_uuid_2", "llama-fine-tuned-2", "llama-8b")], CKPT)
    got = [(r.rank, r.model_id, r.metric_value, r.model_name, r.metric_name)
           for r in L.leaderboard(bench, ck).orderBy("rank").collect()]
    assert got == [(1, "model_uuid_2", 0.94, "llama-fine-tuned-2", "BLEU"),
                   (2, "model_uuid_1", 0.82, "llama-fine-tuned-1", "BLEU")]


def test_tie_keeps_raw_order_and_fallback_name(spark):
    bench = spark.createDataFrame([("b1", "ds", "abcdefghijk", "bleu", 0.82001, "t"),
                                   ("b2", "ds", "m2", "bleu", 0.82004, "t")], BENCH)
    ck = spark.createDataFrame([("m2", "two", "base")], CKPT)
    got = [(r.model_id, r.metric_value, r.model_name, r.base_model)
           for r in L.leaderboard(bench, ck).orderBy("rank").collect()]
    assert got == [("m2", 0.82, "two", "base"), ("abcdefghijk", 0.82, "checkpoint-abcdefgh", "N/A")]


def test_upsert_is_idempotent_last_write_wins(spark):
    cur = spark.createDataFrame([("k1", 1, "a"), ("k2", 1, "b")], "k string, v long, s string")
    upd = spark.createDataFrame([("k1", 2, "c"), ("k3", 1, "d")], "k string, v long, s string")
    once = R.upsert(cur, upd, ["k"], ["v"])
    twice = R.upsert(once, upd, ["k"], ["v"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.k: r.s for r in once.collect()} == {"k1": "c", "k2": "b", "k3": "d"}


def test_promote_default_and_last_promotion(spark):
    entries = spark.createDataFrame([("a", "n1", "adapter", 1), ("b", "n2", "adapter", 2), ("m", "n3", "merged", 3)],
                                    "checkpoint_id string, model_name string, base_model string, registered_seq long")
    none = spark.createDataFrame([], "checkpoint_id string, promoted_at timestamp")
    flags = {r.checkpoint_id: r.is_production for r in R.promote(entries, none).collect()}
    assert flags == {"a": True, "b": False, "m": True}
    promo = spark.createDataFrame([("b", dt.datetime(2024, 1, 1))], "checkpoint_id string, promoted_at timestamp")
    flags = {r.checkpoint_id: r.is_production for r in R.promote(entries, promo).collect()}
    assert flags == {"a": False, "b": True, "m": True}   # the merged model's flag is left alone


def test_lifecycle_audit(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    log = spark.createDataFrame([("d", t[0], 1, 0), ("d", t[1], 2, 1), ("d", t[2], 3, 3), ("d", t[3], 4, 3),
                                 ("d", t[4], 5, 2), ("d", t[5], 6, 5)],
                                "dataset_id string, ts timestamp, event_id long, ord long")
    r = R.lifecycle_audit(log).first()
    assert (r.n_events, r.n_forward, r.n_skipped, r.n_repeat, r.n_reversed, r.current_state) == \
        (6, 1, 2, 1, 1, "ready")


def test_json_skip_and_quarantine(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": 4'), (3, None)], "id int, j string")
    good, bad = R.parse_json_column(df, "j", {"k": "int"})
    assert [(r.id, r.k) for r in good.collect()] == [(1, 3)]
    assert [r.id for r in bad.collect()] == [2]


def test_tag_search_counts(spark):
    ck = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["b"])], "checkpoint_id string, tags array<string>")
    assert [r.checkpoint_id for r in R.tag_search(ck, "a").collect()] == ["c1"]
    assert {r.tag: r.n_checkpoints for r in R.tag_counts(ck).collect()} == {"a": 1, "b": 2}


def test_delete_reports_existing_keys(spark):
    df = spark.createDataFrame([("k1",), ("k2",)], "k string")
    doomed = spark.createDataFrame([("k2",), ("k9",)], "k string")
    rest, hit = R.delete_keys(df, doomed, ["k"])
    assert [r.k for r in rest.collect()] == ["k1"] and [r.k for r in hit.collect()] == ["k2"]
    assert F is not None


def test_typed_json_columns_round_trip(spark):
    from pyspark.sql import types as T

    from tunedata import schemas as SC
    df = spark.createDataFrame([("c1", '["a", "b"]', '{"lr": "0.0002", "r": "16"}')],
                               "checkpoint_id string, tags string, hyperparameters string")
    typed = R.typed_json_columns(df, {"tags": SC.REGISTRY_ENTRY["tags"].dataType,
                                      "hyperparameters": SC.REGISTRY_ENTRY["hyperparameters"].dataType})
    r = typed.first()
    assert r.tags == ["a", "b"] and r.hyperparameters == {"lr": "0.0002", "r": "16"}
    assert isinstance(typed.schema["hyperparameters"].dataType, T.MapType)
    back = typed.select(F.to_json("tags").alias("t")).first().t
    assert back == '["a","b"]'


def test_ranks_by_counting_equal_windows(spark):
    """Many equal values, nulls, a group with most rows; nothing runs while the plan is built."""
    from pyspark.sql import Window
    from tunedata.plans.ordered import rank_by_counting
    df = spark.range(800).select(F.when(F.col("id") % 9 > 0, (F.col("id") % 9 > 2).cast("int")).alias("g"),
                                 F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("a"), (F.col("id") * 31 % 5).alias("b"), "id")
    w = Window.partitionBy("g").orderBy("a", "b", "id")
    want = sorted(map(tuple, df.withColumn("r", F.row_number().over(w).cast("long")).collect()), key=repr)
    for levels, order in (([["a"], ["b"]], ["id"]), ([["a", "b"]], ["id"]), ([], ["a", "b", "id"])):
        assert sorted(map(tuple, rank_by_counting(df, ["g"], levels, order, "r").collect()), key=repr) == want


def test_list_positions(spark):
    import datetime as dt
    rows = [(f"k{i}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=[0, 30, 30, 3600, 90000][i % 5], microseconds=i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = [r.k for r in R.list_recent(df, "ts", "k", "pos").orderBy("pos").collect()]
    assert got == [k for k, t in sorted(sorted(rows), key=lambda r: r[1], reverse=True)]
