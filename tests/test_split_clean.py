"""Splits: exact sizes, reproducibility, ratio checks; cleaning; skew-safe ordering helpers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunedata.operators import clean as C
from tunedata.operators import split as S
from tunedata.plans.ordered import global_rank, neighbour_in_group, row_number_in_group


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "id")


def _sizes(df):
    return {r.split: r.n_rows for r in S.split_sizes(df).collect()}


def test_ten_rows_8_1_1(spark):
    assert _sizes(S.three_way_split(_ids(spark, 10))) == {"train": 8, "validation": 1, "test": 1}


def test_processor_ratios(spark):
    assert _sizes(S.three_way_split(_ids(spark, 3), train=0.6, validation=0.2, test=0.2)) == \
        {"train": 2, "validation": 1}


def test_half_even_rounding(spark):
    # round(0.1 * 25) = round(2.5) = 2 ; round(0.1 * 35) = 4 (3.5000000000000004)
    s25 = _sizes(S.three_way_split(_ids(spark, 25), train=0.8, validation=0.1, test=0.1))
    s35 = _sizes(S.three_way_split(_ids(spark, 35), train=0.8, validation=0.1, test=0.1))
    assert s25["validation"] == round(0.1 * 25) == 2 and s25["train"] == round(0.8 * 25)
    assert s35["validation"] == round(0.1 * 35) == 4


def test_same_seed_same_split_any_partitioning(spark):
    a = S.three_way_split(_ids(spark, 100), train=0.7, validation=0.2, test=0.1, seed=7)
    b = S.three_way_split(_ids(spark, 100).repartition(5), train=0.7, validation=0.2, test=0.1, seed=7)
    assert S.split_overlap(a, b).count() == 0
    assert _sizes(a) == {"train": 70, "validation": 20, "test": 10}
    c = S.three_way_split(_ids(spark, 100), train=0.7, validation=0.2, test=0.1, seed=8)
    assert S.split_overlap(a, c).count() > 0


def test_places_are_selected_from_histograms(spark):
    """The keys at given places, for unique ids, and for ids that fill a third of the rows; wide rows don't move."""
    import hashlib
    from tunedata.plans.ordered import select_places
    ids = [None, *range(500), *[77] * 250]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "id long, text string").repartition(5)
    digest = sorted((hashlib.md5(f"3:{'' if i is None else i}".encode()).hexdigest(), i) for i in ids)
    keys = df.select(S.order_key("id", 3).alias("key"), "id", F.lit(1).cast("long").alias("weight"))
    for digits in (1, 4):
        total, cuts = select_places(keys, lambda n: [0, 1, 333, n - 1, n], digits)
        assert total == len(ids) and [c and (c.key, c.id) for c in cuts] == [digest[0], digest[1], digest[333], digest[-1], None]
        assert all(c.before <= p < c.before + c.weight for c, p in zip(cuts[:4], [0, 1, 333, len(ids) - 1]))
    place = next(p for p, (_, i) in enumerate(digest) if i == 77) + 100              # a cut between rows of one id
    share = (place + 0.25) / len(ids)
    out = S.two_way_split(df, test_size=1 - share, seed=3)
    rows = out.collect()
    assert sorted(r.text for r in rows) == sorted(r.text for r in df.collect())
    assert sum(r.split == "train" for r in rows) == place and sum(r.split == "train" and r.id == 77 for r in rows) == 100
    assert {r.id for r in rows if r.split == "train"} == {i for _, i in digest[:place]}
    assert {r.split for r in S.three_way_split(df, train=0.0, validation=1.0, test=0.0).collect()} == {"validation"}
    assert S.three_way_split(df.limit(0)).count() == 0


def test_split_moves_no_row(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("instruction"))
    for out in (S.three_way_split(df), S.two_way_split(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_bad_ratios_raise():
    with pytest.raises(ValueError):
        S.check_ratios(0.8, 0.2, 0.2)
    with pytest.raises(ValueError):
        S.check_ratios(1.2, -0.1, -0.1)


def test_two_way_uses_ceil(spark):
    sz = _sizes(S.two_way_split(_ids(spark, 11), test_size=0.2))
    assert sz == {"train": 8, "validation": 3}


def test_clean_keeps_first_duplicate(spark):
    df = spark.createDataFrame([(1, " a ", None, "b"), (2, "a", "", "b "), (3, "x", None, None), (4, "c", "i", "d")],
                               "id long, instruction string, input string, output string")
    out = C.clean_instructions(df).orderBy("id").collect()
    assert [(r.id, r.instruction, r.input, r.output) for r in out] == [(1, "a", "", "b"), (4, "c", "i", "d")]
    f = C.cleaning_funnel(df, test_size=0.5).first()
    assert (f.initial_rows, f.null_free_rows, f.duplicates_removed, f.final_rows) == (4, 3, 1, 2)
    assert (f.train_rows, f.validation_rows) == (1, 1)


def test_ordered_helpers_equal_windows(spark):
    # one hot key with most rows, to exercise the range split of a group
    rows = [(0 if i % 3 else i % 7, i // 2, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, t long, u long")
    w = Window.partitionBy("g").orderBy("t", "u")
    expect = {r.u: (r.rn, r.nx, r.pv) for r in df.select(
        "u", F.row_number().over(w).alias("rn"), F.lead("u").over(w).alias("nx"),
        F.lag("u").over(w).alias("pv")).collect()}
    rn = {r.u: r.rn for r in row_number_in_group(df, ["g"], ["t", "u"]).collect()}
    nx = {r.u: r.next_u for r in neighbour_in_group(df, ["g"], ["t", "u"], ["u"], 1, "next_").collect()}
    pv = {r.u: r.prev_u for r in neighbour_in_group(df, ["g"], ["t", "u"], ["u"], -1, "prev_").collect()}
    assert {u: (rn[u], nx[u], pv[u]) for u in rn} == expect
    ranks = sorted(r._rank for r in global_rank(df, ["g", "t", "u"], num_partitions=5).collect())
    assert ranks == list(range(400))


def test_hot_group_spans_several_range_partitions(spark):
    # two thirds of the rows share g = 0; the range shuffle behind global_rank splits them
    rows = [(0 if i % 3 else i % 7, i // 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, t long, u long")
    parts = (df.repartitionByRange(6, "g", "t", "u").filter("g = 0")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts >= 3


def test_pairs_follow_turn_order_without_dense_turns(spark):
    from tunedata.plans import fixtures as X
    turns = [(1, 1, "user", "u1"), (1, 1001, "user", "u1001"), (1, 1023, "assistant", "a1023"), (1, 1024, "user", "u1024"),
             (1, 5000, "assistant", "a5000"), (2, 1, "user", "v1"), (2, 4, "assistant", "b4"), (2, 9, "user", "v9"), (3, 2, "user", "w")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = X.pairs_of(df).collect()
    got = {(r.conv_id, r.turn): (r.output, r.reply_id and int(r.reply_id.split(":")[1])) for r in rows}
    assert got == {(1, 1): (None, None), (1, 1001): ("a1023", 1023), (1, 1024): ("a5000", 5000),
                   (2, 1): ("b4", 4), (2, 9): (None, None), (3, 2): (None, None)}
    assert len({r.id for r in rows}) == len(rows)


def test_stretches_equal_plain_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tunedata.plans.ordered import neighbour_by_stretch, position_by_rows
    df = spark.range(600).select((F.col("id") % 3 % 2).alias("g"), (F.col("id") * 7 % 601).alias("t"), "id")
    w = Window.partitionBy("g").orderBy("t")
    for k, plain in ((1, F.lead("id").over(w)), (-1, F.lag("id").over(w))):
        out = neighbour_by_stretch(df, ["g"], ["t"], ["id"], F.floor(F.col("t") / 10), offset=k, prefix="n_")
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, df.withColumn("n_id", plain).collect()), key=repr)
    out = position_by_rows(df, ["g"], ["t"], "p")
    assert sorted(out.collect()) == sorted(df.withColumn("p", (F.row_number().over(w) - 1).cast("long")).collect())


def test_rows_without_key_or_order_are_kept(spark):
    """Null keys are a group, null orders come first; by stretches and by runs of rows, as plain windows."""
    from tunedata.plans.ordered import neighbour_by_rows, neighbour_by_stretch, position_by_rows
    df = spark.range(900).select(F.when(F.col("id") % 5 < 3, F.col("id") % 5).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 901).alias("t"), "id")
    w = Window.partitionBy("g").orderBy("t", "id")
    for k, plain in ((1, F.lead("id").over(w)), (-1, F.lag("id").over(w))):
        want = sorted(map(tuple, df.withColumn("n_id", plain).collect()), key=repr)
        out = neighbour_by_stretch(df, ["g"], ["t", "id"], ["id"], F.floor(F.col("t") / 10), offset=k, prefix="n_")
        assert sorted(map(tuple, out.collect()), key=repr) == want
        assert sorted(map(tuple, neighbour_by_rows(df, ["g"], ["t", "id"], ["id"], k, "n_").collect()), key=repr) == want
    out = position_by_rows(df, ["g"], ["t", "id"], "p")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, df.withColumn("p", (F.row_number().over(w) - 1).cast("long")).collect()), key=repr)
    assert neighbour_by_rows(df.limit(0), ["g"], ["t", "id"], ["id"]).count() == 0 and position_by_rows(df.limit(0), ["g"], ["t"], "p").count() == 0


def test_runs_are_bounded_when_one_instant_has_all_events(spark, monkeypatch):
    import datetime as dt
    from tunedata.operators import catalog as R
    from tunedata.plans import ordered as O
    monkeypatch.setattr(O, "RUN_BITS", 6)
    log = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("dataset_id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"),
                                   F.col("id").alias("event_id"), (F.col("id") * 7 % 6).alias("ord"))
    runs = O.in_order(log, ["dataset_id", "ts", "event_id"]).groupBy(F.shiftright("_at", 6).alias("run")).count()
    sizes = [r["count"] for r in runs.collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 64
    same = log.select("dataset_id", "ts")                        # rows that are equal in all columns are spread too
    parts = O.in_order(same, ["dataset_id", "ts"]).groupBy(F.shiftright("_at", 33).alias("part")).count().collect()
    assert max(r["count"] for r in parts) < 2500
    got = {r.dataset_id: (r.n_events, r.n_forward, r.n_repeat, r.n_reversed, r.n_skipped) for r in R.lifecycle_audit(log).collect()}
    rows = {None: [], "hot": []}
    for i in range(5000):
        rows["hot" if i % 10 else None].append(i * 7 % 6)
    for k, o in rows.items():
        steps = [b - a for a, b in zip(o, o[1:])]
        assert got[k] == (len(o), steps.count(1), steps.count(0), sum(s < 0 for s in steps), sum(s > 1 for s in steps))


def test_eval_split_choice_prefers_validation_then_train(spark):
    from tunedata.sources.files import eval_split_choice
    splits = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "train"), ("b", "test"),
                                    ("c", "test")], "dataset_id string, split string")
    got = {r.dataset_id: (r.eval_split, r.error) for r in eval_split_choice(splits).collect()}
    assert got == {"a": ("validation", None), "b": ("train", None), "c": (None, "no validation or train split")}


def test_hash_split_is_stable_and_near_ratio(spark):
    df = spark.range(20000)
    a = S.hash_split(df, "id").groupBy("split").count().collect()
    frac = {r.split: r["count"] / 20000 for r in a}
    assert abs(frac["train"] - 0.8) < 0.02 and abs(frac["validation"] - 0.1) < 0.02
    b = S.hash_split(df.repartition(7), "id")
    assert S.split_overlap(S.hash_split(df, "id"), b).count() == 0


def test_records_split_with_a_hot_record(spark):
    """One record in half of the rows: exact sizes, the same rows, the same split for any partitioning, no hot partition."""
    from collections import Counter
    from pyspark.sql import functions as F
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("r"), "id")).alias("text"),
                                   F.when(F.col("id") % 2 == 1, F.col("id")).alias("n"))
    out = S.split_records(df, 0.7, 0.2, 0.1, block=100)
    rows = [tuple(r) for r in out.collect()]
    assert Counter(s for *_, s in rows) == {"train": 28000, "validation": 8000, "test": 4000}
    assert Counter((t, n) for t, n, _ in rows) == Counter(tuple(r) for r in df.collect())
    again = S.split_records(df.repartition(7), 0.7, 0.2, 0.1, block=33)
    assert Counter(rows) == Counter(tuple(r) for r in again.collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in S.split_records(df, 0.7, 0.2, 0.1, block=100).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) <= 2 * sum(sizes) / 4
    assert S.split_records(df.limit(0)).count() == 0


def test_csv_can_be_split_by_bytes(spark, tmp_dir):
    from tunedata.sources import files as FS
    df = spark.range(50).selectExpr("cast(id as string) a", "concat('x \"', id, '\", y') b")
    FS.write_csv(df, tmp_dir + "/c")
    assert sorted(FS.read_csv(spark, tmp_dir + "/c", multi_line=False).collect()) == sorted(df.collect())
