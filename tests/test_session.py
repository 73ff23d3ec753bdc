"""Scratch folders live under the session's checkpoint folder."""

from tunedata.session import ensure_checkpoint_dir, scratch_dir


def test_scratch_dirs_are_fresh_and_under_the_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(base.rstrip("/")) and b.startswith(base.rstrip("/"))


def test_existing_checkpoint_dir_is_kept(spark):
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert ensure_checkpoint_dir(spark) == before
