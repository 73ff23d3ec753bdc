"""Structural guards on the physical plans of every registered query."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
# the one Python step is the Arrow UDF of the LCS lengths: queries that report a ROUGE-L
PYTHON_ALLOWED = {"rouge_l", "rouge_l_pairs", "rouge_lsum_rs", "pair_scores", "metric_summary", "run_aggregates", "rouge_stems"}


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_plan_has_no_cartesian_or_row_udf(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op} in plan"
    if name not in PYTHON_ALLOWED:
        assert "ArrowEvalPython" not in plan, f"{name}: unexpected Python UDF"


@pytest.mark.parametrize("name", ["run_history", "loss_curve", "best_checkpoint", "run_comparison", "run_durations", "windowed_loss",
                                  "ready_only", "lifecycle_audit", "lifecycle_audit_by_time", "status_overlay", "history_view",
                                  "catalog_counts", "readiness_audit", "leaderboard_topk", "leaderboard_entries", "list_recent", "chat_messages"])
def test_no_rank_where_none_is_asked(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "RDDScan" not in plan


def test_one_read(spark):
    plan = E.queries()["cleaning_funnel"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    for name in ("validation_report", "ingest_registry"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, name
    plan = E.queries()["leaderboard_topk"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_are_pruned(spark):
    df = E.queries()["token_estimate"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    df = E.queries()["pair_scores"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in plan
