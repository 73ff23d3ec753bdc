"""Queries for experiment tracking (X), batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import tracking as T
from tunedata.plans import fixtures as X
from tunedata.plans.registry import query
from tunedata.plans.sqlfrag import rnd
from tunedata.streaming import tracking as S

PARAM_KEYS = ["p_click", "p_error", "p_purchase", "p_signup", "p_view"]


def hist(spark, d):
    return X.metric_history(spark, d)


@query("run_history", ctes=("metric_history",), sql="SELECT * FROM metric_history WHERE run_id = 'run7'")
def q_run_history(spark, d):
    return T.run_history(hist(spark, d), "run7")


_PROGRESS_SQL = """
SELECT job_id, state, step, total_steps,
       CASE WHEN total_steps > 0 THEN least(1.0, CAST(step AS DOUBLE) / total_steps) ELSE 0.0 END AS progress
FROM (SELECT job_id, arg_max(state, version) AS state, arg_max(step, version) AS step,
             arg_max(total_steps, version) AS total_steps FROM job_log GROUP BY job_id) q"""


@query("job_progress", ctes=("job_log",), sql=_PROGRESS_SQL)
def q_job_progress(spark, d):
    return T.job_progress(X.job_log(spark, d))


@query("loss_curve", ctes=("metric_history",), sql="""
SELECT run_id, step, 'train' AS series, loss AS value FROM metric_history WHERE loss IS NOT NULL
UNION ALL SELECT run_id, step, 'eval', eval_loss FROM metric_history WHERE eval_loss > 0""")
def q_loss_curve(spark, d):
    return T.loss_curve(hist(spark, d))


@query("best_checkpoint", ctes=("metric_history",), sql="""
SELECT run_id, arg_min(step, (eval_loss, step)) AS best_step, min(eval_loss) AS best_eval_loss
FROM metric_history WHERE eval_loss IS NOT NULL GROUP BY run_id""")
def q_best_checkpoint(spark, d):
    return T.best_checkpoint(hist(spark, d))


_FINAL = """
tr AS (SELECT run_id, arg_max(step, step) AS train_step, arg_max(loss, step) AS train_loss
       FROM metric_history WHERE loss IS NOT NULL GROUP BY run_id),
ev AS (SELECT run_id, arg_max(step, step) AS eval_step, arg_max(eval_loss, step) AS eval_loss
       FROM metric_history WHERE eval_loss IS NOT NULL GROUP BY run_id),
fm AS (SELECT coalesce(tr.run_id, ev.run_id) AS run_id, train_step, train_loss, eval_step, ev.eval_loss
       FROM tr FULL JOIN ev ON tr.run_id = ev.run_id)"""


@query("run_comparison", ctes=("metric_history", "param_log"), sql=f"""
WITH {_FINAL},
w AS (SELECT run_id, {", ".join(f"max(value) FILTER (WHERE key = '{k}') AS {k}" for k in PARAM_KEYS)}
      FROM param_log GROUP BY run_id)
SELECT w.*, fm.train_step, fm.train_loss, fm.eval_step, fm.eval_loss FROM w LEFT JOIN fm ON w.run_id = fm.run_id""")
def q_run_comparison(spark, d):
    return T.run_comparison(X.param_log(spark, d), hist(spark, d), PARAM_KEYS)


@query("run_durations", ctes=("metric_history",), sql="""
SELECT run_id, min(ts) AS started_at, max(ts) AS completed_at,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s
FROM metric_history GROUP BY run_id""")
def q_run_durations(spark, d):
    return T.run_durations(hist(spark, d))


@query("run_metrics_merged", ctes=("metric_history",), sql=f"""
WITH {_FINAL}
SELECT run_id, coalesce(eval_step, train_step) AS step, train_loss AS loss, eval_loss FROM fm""")
def q_run_metrics_merged(spark, d):
    h = hist(spark, d)
    return T.run_metrics_merged(T.last_value(h, "loss"), T.last_value(h, "eval_loss"))


_WINDOW_SQL = f"""
SELECT run_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_rows,
       CASE WHEN count(loss) > 0 THEN {rnd('CAST(sum(CAST(loss AS DECIMAL(18, 4))) AS DOUBLE) / count(loss)', 4)}
       END AS avg_loss
FROM metric_history GROUP BY run_id, time_bucket(INTERVAL 1 HOUR, ts)"""


@query("windowed_loss", ctes=("metric_history",), sql=_WINDOW_SQL)
def q_windowed_loss(spark, d):
    return T.windowed_loss(hist(spark, d))


# ------------------------------------------------------------------ streaming
@query("stream_append", ctes=("metric_history",), sql="SELECT * FROM metric_history")
def q_stream_append(spark, d):
    """Files of step metrics, one per micro-batch and newest first, a slice re-sent -> append sink."""
    h = hist(spark, d)
    w = S.workdir(spark, "stream-append")
    S.stage_arrivals(h, w["src"])
    S.stage_files(h.filter(F.col("loss") > 2).coalesce(1), w["src"])       # a re-sent slice
    out = S.append_dedup(spark, w["src"], h.schema, w["sink"], w["checkpoint"], max_files_per_trigger=1)
    return out.select(*h.columns)


@query("stream_progress", ctes=("job_log",), sql=_PROGRESS_SQL)
def q_stream_progress(spark, d):
    """Latest progress per job from a file stream (stateful aggregate, update mode)."""
    log = X.job_log(spark, d)
    w = S.workdir(spark, "stream-progress")
    S.stage_files(log, w["src"])
    return S.latest_progress(spark, w["src"], log.schema, w["sink"], w["checkpoint"])


@query("stream_window_loss", ctes=("metric_history",), sql=_WINDOW_SQL)
def q_stream_window_loss(spark, d):
    """Event-time windows with a watermark; files arrive newest first (late rows) and a slice is re-sent."""
    h = hist(spark, d)
    w = S.workdir(spark, "stream-window")
    S.stage_arrivals(h, w["src"])
    S.stage_files(h.filter(F.col("loss") > 2).coalesce(1), w["src"])       # a re-sent slice
    return S.windowed_loss_stream(spark, w["src"], h.schema, w["sink"], w["checkpoint"], max_files_per_trigger=1)
