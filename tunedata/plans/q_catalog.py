"""Queries for catalog tables (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import catalog as R
from tunedata.plans import fixtures as X
from tunedata.plans.registry import query
from tunedata.plans.sqlfrag import rnd
from tunedata.streaming import tracking as S

_LATEST_JOBS = """
lj AS (SELECT job_id, version, ts, state, dataset_id, step, total_steps FROM (
         SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY version DESC) AS rn FROM job_log) q WHERE rn = 1)"""

_DS_STATE = """
ds AS (SELECT dataset_id, arg_max(state, (ts, event_id)) AS state FROM lifecycle_log GROUP BY dataset_id)"""


def latest_jobs(spark, d):
    return R.latest_per_key(X.job_log(spark, d), ["job_id"], ["version"])


def dataset_states(spark, d):
    return R.current_state(X.lifecycle_log(spark, d))


@query("upsert_latest", ctes=("job_log",), sql=f"WITH {_LATEST_JOBS} SELECT * FROM lj")
def q_upsert_latest(spark, d):
    return latest_jobs(spark, d)


@query("upsert_merge", ctes=("job_log",), sql=f"WITH {_LATEST_JOBS} SELECT * FROM lj")
def q_upsert_merge(spark, d):
    """R1 as a merge: the catalog as of mid-month, upserted with the later versions."""
    log = X.job_log(spark, d)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    current = R.latest_per_key(log.filter(F.col("ts") < cut), ["job_id"], ["version"])
    return R.upsert(current, log.filter(F.col("ts") >= cut), ["job_id"], ["version"])


@query("lookup_semi", ctes=("job_log",), sql=f"""
WITH {_LATEST_JOBS}
SELECT * FROM lj WHERE job_id IN (SELECT 'job' || CAST(c_custkey AS VARCHAR) FROM customer
                                  WHERE c_mktsegment = 'BUILDING')""")
def q_lookup_semi(spark, d):
    keys = (X.table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
            .select(F.concat(F.lit("job"), F.col("c_custkey").cast("string")).alias("job_id")))
    return R.lookup(latest_jobs(spark, d), keys, ["job_id"])


@query("list_recent", ctes=("job_log",), sql=f"""
WITH {_LATEST_JOBS}
SELECT * FROM lj""")
def q_list_recent(spark, d):
    return R.list_recent(latest_jobs(spark, d), "ts", "job_id")


def _metrics_text(spark, d):
    """Evaluation rows with a JSON metrics column; error events carry a truncated (broken) text."""
    e = X.table(spark, d, "events")
    txt = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)")) \
        .otherwise(F.col("props"))
    return e.select("event_id", "user_id", txt.alias("metrics_json"))


_MJ = """
mj AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1)
                                      ELSE props END AS metrics_json FROM events)"""


@query("json_skip_malformed", sql=f"""
WITH {_MJ}
SELECT event_id, CAST(json_extract_string(metrics_json, '$.k') AS INTEGER) AS k FROM mj WHERE json_valid(metrics_json)""")
def q_json_skip_malformed(spark, d):
    good, _ = R.parse_json_column(_metrics_text(spark, d), "metrics_json", {"k": "int"})
    return good.select("event_id", "k")


@query("json_quarantine", sql=f"""
WITH {_MJ} SELECT event_id, metrics_json FROM mj WHERE NOT json_valid(metrics_json)""")
def q_json_quarantine(spark, d):
    _, bad = R.parse_json_column(_metrics_text(spark, d), "metrics_json", {"k": "int"})
    return bad.select("event_id", "metrics_json")


@query("metrics_json", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(to_json({'k': CAST(json_extract_string(props, '$.k') AS INTEGER), 'user_id': user_id}) AS VARCHAR)
         AS metrics_text
FROM events""")
def q_metrics_json(spark, d):
    """JSON text -> typed field -> JSON text."""
    e = X.table(spark, d, "events")
    good, _ = R.parse_json_column(e.select("event_id", "user_id", "props"), "props", {"k": "int"})
    return good.select("event_id", "k", F.to_json(F.struct("k", "user_id")).alias("metrics_text"))


_DOOMED = "(SELECT 'job' || CAST(c_custkey AS VARCHAR) AS job_id FROM customer WHERE c_acctbal < 0)"


def _doomed(spark, d):
    return (X.table(spark, d, "customer").filter(F.col("c_acctbal") < 0)
            .select(F.concat(F.lit("job"), F.col("c_custkey").cast("string")).alias("job_id")))


@query("delete_anti", ctes=("job_log",), sql=f"""
WITH {_LATEST_JOBS} SELECT * FROM lj WHERE job_id NOT IN {_DOOMED}""")
def q_delete_anti(spark, d):
    remaining, _ = R.delete_keys(latest_jobs(spark, d), _doomed(spark, d), ["job_id"])
    return remaining


@query("delete_hits", ctes=("job_log",), sql=f"""
WITH {_LATEST_JOBS} SELECT DISTINCT job_id FROM {_DOOMED} x WHERE job_id IN (SELECT job_id FROM lj)""")
def q_delete_hits(spark, d):
    _, existed = R.delete_keys(latest_jobs(spark, d), _doomed(spark, d), ["job_id"])
    return existed


@query("ready_only", ctes=("lifecycle_log",), sql=f"""
WITH {_DS_STATE} SELECT dataset_id, state FROM ds WHERE state = 'ready'""")
def q_ready_only(spark, d):
    return R.ready_only(dataset_states(spark, d))


@query("tag_search", ctes=("checkpoints",), sql="""
SELECT checkpoint_id, model_name, base_model FROM checkpoints WHERE list_contains(tags, 'building')""")
def q_tag_search(spark, d):
    return R.tag_search(X.checkpoints(spark, d), "building").select("checkpoint_id", "model_name", "base_model")


@query("tag_counts", ctes=("checkpoints",), sql="""
SELECT tag, count(*) AS n_checkpoints FROM (SELECT unnest(list_distinct(tags)) AS tag FROM checkpoints) q GROUP BY tag""")
def q_tag_counts(spark, d):
    return R.tag_counts(X.checkpoints(spark, d))


_PROMO = """
pr AS (SELECT 'ckpt' || CAST(user_id AS VARCHAR) AS checkpoint_id, ts AS promoted_at FROM events
       WHERE event_type = 'purchase'),
pt AS (SELECT c.base_model, arg_max(c.checkpoint_id, (pr.promoted_at, c.checkpoint_id)) AS promoted
       FROM pr JOIN checkpoints c ON pr.checkpoint_id = c.checkpoint_id GROUP BY c.base_model),
ft AS (SELECT base_model, arg_min(checkpoint_id, (registered_seq, checkpoint_id)) AS first FROM checkpoints
       GROUP BY base_model),
fl AS (SELECT c.checkpoint_id, c.model_name, c.base_model,
              c.checkpoint_id = coalesce(pt.promoted, ft.first) AS is_production
       FROM checkpoints c LEFT JOIN ft ON c.base_model = ft.base_model LEFT JOIN pt ON c.base_model = pt.base_model)"""


def _promotions(spark, d):
    e = X.table(spark, d, "events").filter(F.col("event_type") == "purchase")
    return e.select(F.concat(F.lit("ckpt"), F.col("user_id").cast("string")).alias("checkpoint_id"),
                    F.col("ts").alias("promoted_at"))


@query("promote", ctes=("checkpoints",), sql=f"WITH {_PROMO} SELECT checkpoint_id, base_model, is_production FROM fl")
def q_promote(spark, d):
    flagged = R.promote(X.checkpoints(spark, d), _promotions(spark, d))
    return flagged.select("checkpoint_id", "base_model", "is_production")


@query("production_entry", ctes=("checkpoints",), sql=f"""
WITH {_PROMO}
SELECT base_model, arg_min(checkpoint_id, (model_name, checkpoint_id)) AS checkpoint_id FROM fl
WHERE is_production GROUP BY base_model""")
def q_production_entry(spark, d):
    return R.production_entry(R.promote(X.checkpoints(spark, d), _promotions(spark, d)))


_LIFECYCLE_SQL = """
WITH p AS (SELECT *, lag(ord) OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS prev_ord FROM lifecycle_log),
t AS (SELECT *, CASE WHEN prev_ord IS NULL THEN CASE WHEN ord = 0 THEN 'start' ELSE 'bad_start' END
                     WHEN ord = prev_ord + 1 THEN 'forward' WHEN ord = prev_ord THEN 'repeat'
                     WHEN ord < prev_ord THEN 'reversed' ELSE 'skipped' END AS transition FROM p)
SELECT dataset_id, count(*) AS n_events, CAST(count_if(transition = 'forward') AS BIGINT) AS n_forward,
       CAST(count_if(transition = 'repeat') AS BIGINT) AS n_repeat,
       CAST(count_if(transition = 'reversed') AS BIGINT) AS n_reversed,
       CAST(count_if(transition = 'skipped') AS BIGINT) AS n_skipped, arg_max(state, (ts, event_id)) AS current_state
FROM t GROUP BY dataset_id"""


@query("lifecycle_audit", ctes=("lifecycle_log",), sql=_LIFECYCLE_SQL.replace("ORDER BY ts, event_id", "ORDER BY event_id")
       .replace("(ts, event_id)", "event_id"))
def q_lifecycle_audit(spark, d):
    """R11 over a log with a sequence number."""
    return R.lifecycle_audit(X.lifecycle_log(spark, d), seq_col="event_id")


@query("lifecycle_audit_by_time", ctes=("lifecycle_log",), sql=_LIFECYCLE_SQL)
def q_lifecycle_audit_by_time(spark, d):
    """R11 over a log ordered only by time."""
    return R.lifecycle_audit(X.lifecycle_log(spark, d))


_PROGRESS = """
pg AS (SELECT 'job' || substr(run_id, 4) AS job_id, arg_max(step, step) AS step,
              arg_max(coalesce(loss, eval_loss), step) AS loss FROM metric_history GROUP BY run_id),
ov AS (SELECT lj.job_id, lj.state, lj.ts, coalesce(pg.step, lj.step) AS step, pg.loss
       FROM lj LEFT JOIN pg ON lj.job_id = pg.job_id)"""


def _overlay(spark, d):
    stored = latest_jobs(spark, d).select("job_id", "state", "ts", F.col("step").cast("long").alias("step"),
                                          F.lit(None).cast("double").alias("loss"))
    mh = X.metric_history(spark, d)
    prog = (mh.groupBy("run_id").agg(F.max_by(F.struct("step", F.coalesce("loss", "eval_loss").alias("loss")),
                                              "step").alias("_p"))
            .select(F.concat(F.lit("job"), F.expr("substr(run_id, 4)")).alias("job_id"),
                    F.col("_p.step").alias("step"), F.col("_p.loss").alias("loss")))
    return R.status_overlay(stored, prog, "job_id", ["step", "loss"])


@query("status_overlay", ctes=("job_log", "metric_history"), sql=f"""
WITH {_LATEST_JOBS}, {_PROGRESS} SELECT job_id, state, ts, CAST(step AS BIGINT) AS step, loss FROM ov""")
def q_status_overlay(spark, d):
    return _overlay(spark, d)


@query("status_overlay_stream", ctes=("job_log", "metric_history"), sql=f"""
WITH {_LATEST_JOBS}, {_PROGRESS} SELECT job_id, state, ts, CAST(step AS BIGINT) AS step, loss FROM ov""")
def q_status_overlay_stream(spark, d):
    """R12 while jobs run: metric files stream in, stored rows are overlaid batch by batch."""
    stored = latest_jobs(spark, d).select("job_id", "state", "ts", F.col("step").cast("long").alias("step"),
                                          F.lit(None).cast("double").alias("loss"))
    live = X.metric_history(spark, d).select(F.concat(F.lit("job"), F.expr("substr(run_id, 4)")).alias("job_id"), "ts", "step",
                                             F.coalesce("loss", "eval_loss").alias("loss"))
    w = S.workdir(spark, "stream-overlay")
    S.stage_arrivals(live, w["src"])
    return S.live_overlay(spark, stored, w["src"], live.schema, w["sink"], w["checkpoint"], "job_id", ["step", "loss"], "step", max_files_per_trigger=1)


@query("history_view", ctes=("job_log", "metric_history"), sql=f"""
WITH {_LATEST_JOBS}, {_PROGRESS}
SELECT substr(job_id, 1, 8) AS short_id, upper(state) AS state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated,
       CASE WHEN loss IS NULL THEN 'N/A' ELSE printf('%.4f', {rnd('loss', 4)}) END AS loss FROM ov""")
def q_history_view(spark, d):
    return R.history_view(_overlay(spark, d))


@query("catalog_counts", ctes=("job_log", "lifecycle_log", "checkpoints"), sql=f"""
WITH {_LATEST_JOBS}, {_DS_STATE}
SELECT 'job' AS entity, state, count(*) AS n FROM lj GROUP BY state
UNION ALL SELECT 'dataset', state, count(*) FROM ds GROUP BY state
UNION ALL SELECT 'checkpoint', 'registered', count(*) FROM checkpoints""")
def q_catalog_counts(spark, d):
    jobs = latest_jobs(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("job").alias("entity"), "state", "n")
    ds = dataset_states(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("dataset").alias("entity"), "state", "n")
    ck = X.checkpoints(spark, d).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("checkpoint").alias("entity"), F.lit("registered").alias("state"), "n")
    return jobs.unionByName(ds).unionByName(ck)


@query("readiness_audit", ctes=("job_log", "lifecycle_log"), sql=f"""
WITH {_LATEST_JOBS}, {_DS_STATE}
SELECT lj.job_id, lj.dataset_id, ds.state AS dataset_state,
       CASE WHEN ds.state IS NULL THEN 'dataset_missing' WHEN ds.state <> 'ready' THEN 'dataset_not_ready'
            ELSE 'ok' END AS reason
FROM lj LEFT JOIN ds ON lj.dataset_id = ds.dataset_id""")
def q_readiness_audit(spark, d):
    return R.readiness_audit(latest_jobs(spark, d), dataset_states(spark, d)).select(
        "job_id", "dataset_id", "dataset_state", "reason")
