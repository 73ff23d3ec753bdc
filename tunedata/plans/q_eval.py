"""Queries for evaluation metrics (E) and leaderboards (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.functions.text import rouge_tokens, round4
from tunedata.operators import leaderboard as L
from tunedata.operators import metrics as M
from tunedata.plans import fixtures as X
from tunedata.plans.registry import ORACLE, query
from tunedata.session import scratch_dir
from tunedata.sources import files as S
from tunedata.plans.sqlfrag import lcs, rnd, rouge_toks, strip, toks

KEYS = ["id", "model_id"]
#: word ends taken off by the stem table of ``rouge_stems`` (any stemmer's table will do)
SUFFIX = "(ing|ed|es|s|o|a|e)$"
HOURLY_COST = 0.35   # price of one inference host hour used by perf_matrix (a parameter)


def preds(spark, d):
    return X.predictions(spark, d)


# -------------------------------------------------------------- SQL fragments
def _overlap_sql(pt: str, rt: str, src: str = "predictions") -> str:
    """CTE ``ov``: per (id, model_id) n_pred, n_ref, overlap for token-array expressions."""
    return f"""
t AS (SELECT id, model_id, {pt} AS pt, {rt} AS rt FROM {src}),
pc AS (SELECT id, model_id, tok, count(*) AS c FROM (SELECT id, model_id, unnest(pt) AS tok FROM t) q GROUP BY ALL),
rc AS (SELECT id, model_id, tok, count(*) AS c FROM (SELECT id, model_id, unnest(rt) AS tok FROM t) q GROUP BY ALL),
ov0 AS (SELECT id, model_id, sum(least(pc.c, rc.c)) AS overlap FROM pc JOIN rc USING (id, model_id, tok) GROUP BY ALL),
ov AS (SELECT id, model_id, CAST(len(pt) AS BIGINT) AS n_pred, CAST(len(rt) AS BIGINT) AS n_ref,
              CAST(coalesce(overlap, 0) AS BIGINT) AS overlap FROM t LEFT JOIN ov0 USING (id, model_id))"""


def _bigrams(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"


_BLEU_SQL = f"""WITH {_overlap_sql(toks('lower(prediction)'), toks('lower(reference)'))},
bl AS (SELECT id, model_id, CASE WHEN n_pred = 0 OR n_ref = 0 THEN 0.0
                                 ELSE CAST(overlap AS DOUBLE) / n_pred END AS bleu1 FROM ov)"""

_F_SQL = ("CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END")


def _stemmed(x: str) -> str:
    return f"list_transform({x}, lambda w: CASE WHEN length(w) >= 4 THEN regexp_replace(w, '{SUFFIX}', '') ELSE w END)"


def _rouge_n_sql(n: int, shape=str) -> str:
    # tokens first (a column), then the n-grams read that column
    src = (f"(SELECT id, model_id, {shape(rouge_toks('prediction'))} AS tp, {shape(rouge_toks('reference'))} AS tr "
           f"FROM predictions)")
    rp, rr = ("tp", "tr") if n == 1 else (_bigrams("tp"), _bigrams("tr"))
    return f"""WITH {_overlap_sql(rp, rr, src)},
pr AS (SELECT id, model_id, CAST(overlap AS DOUBLE) / greatest(n_pred, 1) AS p,
              CAST(overlap AS DOUBLE) / greatest(n_ref, 1) AS r FROM ov),
rn AS (SELECT id, model_id, {_F_SQL} AS rouge{n} FROM pr)"""


_WF1_SQL = f"""
WITH w AS (SELECT id, model_id,
  CAST(len(list_intersect(list_distinct({toks('lower(reference)')}), list_distinct({toks('lower(prediction)')})))
       AS DOUBLE) AS common,
  greatest(len({toks('prediction')}), 1) AS np, greatest(len({toks('reference')}), 1) AS nr FROM predictions),
pr AS (SELECT id, model_id, common / np AS p, common / nr AS r FROM w),
wf AS (SELECT id, model_id, CASE WHEN p + r > 0 THEN (2.0 * p * r) / (p + r) ELSE 0.0 END AS word_f1 FROM pr)"""

_EM = f"CAST({strip('lower(prediction)')} = {strip('lower(reference)')} AS DOUBLE)"


def _lcs_pairs_sql(rouge_rule: bool, out: str) -> str:
    tk = (lambda x: f"({rouge_toks(x)})") if rouge_rule else (lambda x: toks(f"lower({x})"))
    f = ("CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END" if rouge_rule
         else "CASE WHEN r + p > 0 THEN (2.0 * r * p) / (r + p) ELSE 0.0 END")
    return f"""
SELECT id, model_id, CASE WHEN np = 0 OR nr = 0 THEN 0.0 ELSE {f} END AS {out} FROM (
  SELECT id, model_id, np, nr, CAST(l AS DOUBLE) / nr AS r, CAST(l AS DOUBLE) / np AS p FROM (
    SELECT id, model_id, len(pa) AS np, len(rb) AS nr, {lcs('pa', 'rb')} AS l
    FROM (SELECT id, model_id, {tk('prediction')} AS pa, {tk('reference')} AS rb FROM predictions) t0) t1) t2"""


_RL = _lcs_pairs_sql(False, "rouge_l")
_RLS = _lcs_pairs_sql(True, "rougeL")

_PAIR_SQL_CTES = f"""
WITH b AS ({_BLEU_SQL} SELECT * FROM bl),
r1 AS ({_rouge_n_sql(1)} SELECT * FROM rn),
r2 AS ({_rouge_n_sql(2)} SELECT * FROM rn),
rl AS ({_RL}),
rs AS ({_RLS}),
w AS ({_WF1_SQL} SELECT * FROM wf),
ps AS (SELECT p.id, p.model_id, b.bleu1, rl.rouge_l, r1.rouge1, r2.rouge2, rs.rougeL, {_EM} AS exact_match,
              w.word_f1, p.latency_ms, p.tokens
       FROM predictions p JOIN b USING (id, model_id) JOIN rl USING (id, model_id) JOIN r1 USING (id, model_id)
       JOIN r2 USING (id, model_id) JOIN rs USING (id, model_id) JOIN w USING (id, model_id))"""


# --------------------------------------------------------------------- pairing
@query("pair_predictions", ctes=("sft_pairs", "predictions"), sql="""
SELECT s.id AS sample_id, p.model_id, coalesce(s.output, '') AS reference, coalesce(p.prediction, '') AS prediction
FROM sft_pairs s LEFT JOIN predictions p ON s.reply_id = p.id""")
def q_pair_predictions(spark, d):
    samples = X.sft_pairs(spark, d).select(F.col("id").alias("sample_id"), "reply_id", F.col("output").alias("reference"))
    p = preds(spark, d).select(F.col("id").alias("reply_id"), "model_id", "prediction")
    return M.pair_predictions(samples, p, ["reply_id"]).select("sample_id", "model_id", "reference", "prediction")


# --------------------------------------------------------------------- metrics
@query("bleu1_pairs", ctes=("predictions",), sql=_BLEU_SQL + " SELECT * FROM bl")
def q_bleu1_pairs(spark, d):
    return M.bleu1_pairs(preds(spark, d), KEYS)


@query("bleu1", ctes=("predictions",), sql=_BLEU_SQL + f"""
SELECT model_id, {rnd('avg(bleu1)', 4)} AS bleu FROM bl GROUP BY model_id""")
def q_bleu1(spark, d):
    return M.bleu1_pairs(preds(spark, d), KEYS).groupBy("model_id").agg(round4(F.avg("bleu1")).alias("bleu"))


@query("rouge_l_pairs", ctes=("predictions",), sql=_RL)
def q_rouge_l_pairs(spark, d):
    return M.rouge_l_pairs(preds(spark, d), KEYS)


@query("rouge_l", ctes=("predictions",), sql=f"""
SELECT model_id, {rnd('avg(rouge_l)', 4)} AS rouge_l FROM ({_RL}) q GROUP BY model_id""")
def q_rouge_l(spark, d):
    return M.rouge_l_pairs(preds(spark, d), KEYS).groupBy("model_id").agg(
        round4(F.avg("rouge_l")).alias("rouge_l"))


@query("rouge_n", ctes=("predictions",), sql=f"""
WITH r1 AS ({_rouge_n_sql(1)} SELECT * FROM rn), r2 AS ({_rouge_n_sql(2)} SELECT * FROM rn)
SELECT model_id, {rnd('avg(rouge1)', 4)} AS rouge1, {rnd('avg(rouge2)', 4)} AS rouge2
FROM r1 JOIN r2 USING (id, model_id) GROUP BY model_id""")
def q_rouge_n(spark, d):
    j = M.pair_scores(preds(spark, d), KEYS, ["rouge1", "rouge2"])
    return j.groupBy("model_id").agg(round4(F.avg("rouge1")).alias("rouge1"), round4(F.avg("rouge2")).alias("rouge2"))


@query("rouge_lsum_rs", ctes=("predictions",), sql=f"""
SELECT model_id, {rnd('avg(rougeL)', 4)} AS rougeL FROM ({_RLS}) q GROUP BY model_id""")
def q_rouge_l_rs(spark, d):
    """ROUGE-L on the rouge-score token rule (the metric of the evaluation script)."""
    return M.rouge_l_pairs(preds(spark, d), KEYS, rouge_score_tokens=True, out="rougeL") \
        .groupBy("model_id").agg(round4(F.avg("rougeL")).alias("rougeL"))


@query("exact_match", ctes=("predictions",), sql=f"""
SELECT model_id, {rnd(f'avg({_EM})', 4)} AS exact_match FROM predictions GROUP BY model_id""")
def q_exact_match(spark, d):
    return preds(spark, d).groupBy("model_id").agg(round4(F.avg(M.exact_match())).alias("exact_match"))


@query("word_set_f1", ctes=("predictions",), sql=_WF1_SQL + f"""
SELECT model_id, {rnd('avg(word_f1)', 4)} AS word_f1 FROM wf GROUP BY model_id""")
def q_word_set_f1(spark, d):
    return M.word_set_f1_pairs(preds(spark, d), KEYS).groupBy("model_id").agg(
        round4(F.avg("word_f1")).alias("word_f1"))


@query("word_set_f1_pairs", ctes=("predictions",), sql=_WF1_SQL + " SELECT * FROM wf")
def q_word_set_f1_pairs(spark, d):
    return M.word_set_f1_pairs(preds(spark, d), KEYS)


# -------------------------------------------------------------- classification
_NORM = f"""
n AS (SELECT model_id, lower({strip("coalesce(reference, '')")}) AS rl,
             lower({strip("coalesce(prediction, '')")}) AS pl FROM class_pred),
cm AS (SELECT model_id, rl, pl, count(*) AS n FROM n GROUP BY ALL),
br AS (SELECT model_id, rl AS label, sum(n) AS ref_total, sum(CASE WHEN rl = pl THEN n ELSE 0 END) AS tp
       FROM cm GROUP BY ALL),
bp AS (SELECT model_id, pl AS label, sum(n) AS pred_total FROM cm GROUP BY ALL),
cr AS (SELECT br.model_id, br.label, CAST(tp AS BIGINT) AS tp, CAST(coalesce(pred_total, 0) - tp AS BIGINT) AS fp,
              CAST(ref_total - tp AS BIGINT) AS fn,
              CASE WHEN coalesce(pred_total, 0) > 0 THEN CAST(tp AS DOUBLE) / CAST(pred_total AS DOUBLE)
                   ELSE 0.0 END AS precision,
              CASE WHEN ref_total > 0 THEN CAST(tp AS DOUBLE) / CAST(ref_total AS DOUBLE) ELSE 0.0 END AS recall
       FROM br LEFT JOIN bp ON br.model_id = bp.model_id AND br.label = bp.label),
acc AS (SELECT model_id, avg(CASE WHEN rl = pl THEN 1.0 ELSE 0.0 END) AS accuracy FROM n GROUP BY model_id),
ms AS (SELECT acc.model_id, accuracy, coalesce(p, 0.0) AS precision, coalesce(r, 0.0) AS recall,
              CASE WHEN p + r > 0 THEN (2.0 * p * r) / (p + r) ELSE 0.0 END AS f1_score
       FROM acc LEFT JOIN (SELECT model_id, avg(precision) AS p, avg(recall) AS r FROM cr GROUP BY model_id) x
       ON acc.model_id = x.model_id)"""


def cls(spark, d):
    return X.class_pred(spark, d)


@query("confusion", ctes=("class_pred",), sql=f"WITH {_NORM} SELECT model_id, rl AS ref_label, pl AS pred_label, "
                                              f"CAST(n AS BIGINT) AS n FROM cm")
def q_confusion(spark, d):
    return M.confusion(cls(spark, d), ["model_id"])


@query("class_report", ctes=("class_pred",), sql=f"WITH {_NORM} SELECT * FROM cr")
def q_class_report(spark, d):
    return M.class_report(cls(spark, d), ["model_id"])


@query("accuracy", ctes=("class_pred",), sql=f"WITH {_NORM} SELECT model_id, {rnd('accuracy', 4)} AS accuracy FROM acc")
def q_accuracy(spark, d):
    return M.macro_scores(cls(spark, d), ["model_id"]).select("model_id", round4("accuracy").alias("accuracy"))


@query("macro_scores", ctes=("class_pred",), sql=f"""
WITH {_NORM} SELECT model_id, {rnd('accuracy', 4)} AS accuracy, {rnd('precision', 4)} AS precision,
                    {rnd('recall', 4)} AS recall, {rnd('f1_score', 4)} AS f1_score FROM ms""")
def q_macro_scores(spark, d):
    return M.classification_summary(cls(spark, d), ["model_id"]).select(
        "model_id", "accuracy", "precision", "recall", "f1_score")


_CLS_SUMMARY = f"""
cs AS (SELECT model_id, 'classification' AS task_type, CAST(NULL AS DOUBLE) AS bleu,
              CAST(NULL AS DOUBLE) AS rouge_l, CAST(NULL AS DOUBLE) AS bert_score,
              {rnd('accuracy', 4)} AS accuracy, {rnd('precision', 4)} AS precision,
              {rnd('recall', 4)} AS recall, {rnd('f1_score', 4)} AS f1_score FROM ms)"""


@query("metric_summary_cls", ctes=("class_pred",), sql=f"WITH {_NORM}, {_CLS_SUMMARY} SELECT * FROM cs")
def q_metric_summary_cls(spark, d):
    return M.classification_summary(cls(spark, d), ["model_id"])


@query("metric_summary", ctes=("predictions", "class_pred"), sql=f"""
WITH {_NORM.strip()}, {_CLS_SUMMARY.strip()},
b AS ({_BLEU_SQL} SELECT * FROM bl),
rl AS ({_RL}),
g AS (SELECT model_id, 'generation' AS task_type, {rnd('avg(bleu1)', 4)} AS bleu, {rnd('avg(rouge_l)', 4)} AS rouge_l,
             CAST(NULL AS DOUBLE) AS bert_score, CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS DOUBLE) AS precision,
             CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1_score
      FROM b JOIN rl USING (id, model_id) GROUP BY model_id)
SELECT * FROM g UNION ALL SELECT * FROM cs""")
def q_metric_summary(spark, d):
    """Generation models (BLEU-1, ROUGE-L) and classifiers in one table."""
    gen = M.generation_summary(preds(spark, d), ["model_id"], KEYS)
    return gen.unionByName(M.classification_summary(cls(spark, d), ["model_id"]))


@query("metrics_long", ctes=("class_pred",), sql=f"""
WITH {_NORM}, {_CLS_SUMMARY}
SELECT model_id, metric, {rnd('value', 4)} AS value FROM (
  SELECT model_id, 'ACCURACY' AS metric, accuracy AS value FROM cs UNION ALL
  SELECT model_id, 'PRECISION', precision FROM cs UNION ALL
  SELECT model_id, 'RECALL', recall FROM cs UNION ALL
  SELECT model_id, 'F1_SCORE', f1_score FROM cs) q""")
def q_metrics_long(spark, d):
    return M.metrics_long(M.classification_summary(cls(spark, d), ["model_id"]), ["model_id"])


@query("primary_metric", ctes=("predictions", "class_pred"), sql=_BLEU_SQL.replace("WITH ", "WITH " + _NORM.strip() + ",\n", 1) + f"""
SELECT model_id, 'generation' AS task_type, coalesce({rnd('avg(bleu1)', 4)}, 0.0) AS primary_metric
FROM bl GROUP BY model_id
UNION ALL SELECT model_id, 'classification', coalesce({rnd('accuracy', 4)}, 0.0) FROM acc""")
def q_primary_metric(spark, d):
    gen = M.bleu1_pairs(preds(spark, d), KEYS).groupBy("model_id").agg(
        F.lit(M.GENERATION).alias("task_type"), round4(F.avg("bleu1")).alias("bleu"),
        F.lit(None).cast("double").alias("accuracy"))
    cl = M.classification_summary(cls(spark, d), ["model_id"]).select("model_id", "task_type", "bleu", "accuracy")
    both = gen.unionByName(cl)
    return both.select("model_id", "task_type", M.primary_metric(both).alias("primary_metric"))


@query("run_aggregates", ctes=("predictions",), sql=_PAIR_SQL_CTES + f"""
SELECT model_id,
       {rnd('sum(CAST(latency_ms AS DOUBLE)) / greatest(count(*), 1)', 2)} AS avg_latency_ms,
       CASE WHEN sum(CAST(latency_ms AS DOUBLE)) > 0
            THEN {rnd('sum(CAST(tokens AS DOUBLE)) / (sum(CAST(latency_ms AS DOUBLE)) / 1000)', 2)} ELSE 0.0 END
         AS avg_throughput_tps,
       {rnd('sum(rouge1) / greatest(count(*), 1)', 4)} AS mean_rouge1,
       {rnd('sum(rouge2) / greatest(count(*), 1)', 4)} AS mean_rouge2,
       {rnd('sum(rougeL) / greatest(count(*), 1)', 4)} AS mean_rougeL,
       {rnd('sum(exact_match) / greatest(count(*), 1)', 4)} AS mean_exact_match,
       CAST(greatest(count(*), 1) AS BIGINT) AS total_samples
FROM ps GROUP BY model_id""")
def q_run_aggregates(spark, d):
    """Per model latency/throughput and mean ROUGE-1/2/L (rouge-score rule) and exact match."""
    scored = M.pair_scores(preds(spark, d), KEYS, ["rouge1", "rouge2", "rougeL", "exact_match"],
                           carry=("latency_ms", "tokens"))
    return M.run_aggregates(scored, ["model_id"])


@query("pair_scores", ctes=("predictions",), sql=_PAIR_SQL_CTES + """
SELECT id, model_id, bleu1, rouge_l, rouge1, rouge2, rougeL, exact_match, word_f1 FROM ps""")
def q_pair_scores(spark, d):
    """Every per-pair metric in one pass (BLEU-1, ROUGE-1/2/L both token rules, EM, word F1)."""
    return M.pair_scores(preds(spark, d), KEYS)


@query("report_preview", ctes=("predictions",), sql=f"""
SELECT model_id, id,
       CASE WHEN length(replace(reference, chr(10), ' ')) > 50
            THEN substr(replace(reference, chr(10), ' '), 1, 50) || '...' ELSE replace(reference, chr(10), ' ') END
         AS reference_preview,
       CASE WHEN length(replace(prediction, chr(10), ' ')) > 50
            THEN substr(replace(prediction, chr(10), ' '), 1, 50) || '...' ELSE replace(prediction, chr(10), ' ') END
         AS prediction_preview
FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY id) AS rn FROM predictions) q WHERE rn <= 10""")
def q_report_preview(spark, d):
    """The first 10 samples of every evaluation (a top-k per group is the feature)."""
    from pyspark.sql import Window
    w = Window.partitionBy("model_id").orderBy("id")
    p = preds(spark, d).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 10)
    return p.select("model_id", "id", M.preview_text("reference").alias("reference_preview"),
                    M.preview_text("prediction").alias("prediction_preview"))


@query("rouge_stems", ctes=("predictions",), sql=f"""
WITH r1 AS ({_rouge_n_sql(1, _stemmed)} SELECT * FROM rn), r2 AS ({_rouge_n_sql(2, _stemmed)} SELECT * FROM rn)
SELECT id, model_id, rouge1, rouge2 FROM r1 JOIN r2 USING (id, model_id)""")
def q_rouge_stems(spark, d):
    """E4 with stems: tokens of four and more characters go through a stem table of the vocabulary."""
    p = preds(spark, d)
    words = p.select(F.explode(F.array_union(rouge_tokens("prediction"), rouge_tokens("reference"))).alias("token")).distinct()
    stems = words.where(F.length("token") >= 4).select("token", F.regexp_replace("token", SUFFIX, "").alias("stem"))
    return M.pair_scores(p, KEYS, ["rouge1", "rouge2"], stems=stems)


@query("prediction_sheet", ctes=("sft_pairs", "predictions"), sql=_PAIR_SQL_CTES + f""",
sh AS (SELECT p.id, p.model_id, coalesce(s.instruction, '') AS prompt, p.reference AS ground_truth, p.prediction
       FROM predictions p LEFT JOIN sft_pairs s ON p.id = s.reply_id)
SELECT id, model_id, prompt, ground_truth, prediction, CAST(latency_ms AS DOUBLE) AS latency_ms, tokens AS tokens_generated,
       {rnd('rouge1', 4)} AS rouge1, {rnd('rouge2', 4)} AS rouge2, {rnd('rougeL', 4)} AS "rougeL", exact_match
FROM ps JOIN sh USING (id, model_id)""")
def q_prediction_sheet(spark, d):
    """The sheet of scored generations (prompt, truth, prediction, latency, tokens, scores), written as CSV and read back."""
    prompts = X.sft_pairs(spark, d).where("reply_id is not null").select(F.col("reply_id").alias("id"), "instruction")
    p = preds(spark, d).join(prompts, "id", "left").withColumn("prompt", F.coalesce("instruction", F.lit("")))
    carry = ("prompt", "reference", "prediction", "latency_ms", "tokens")
    scored = M.pair_scores(p, KEYS, ["rouge1", "rouge2", "rougeL", "exact_match"], carry=carry)
    path = scratch_dir(spark, "prediction-sheet")
    S.write_csv(M.prediction_sheet(scored, KEYS), path)
    kinds = {"tokens_generated": "long", **{c: "double" for c in ("latency_ms", "rouge1", "rouge2", "rougeL", "exact_match")}}
    back = S.read_csv(spark, path)
    return back.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in back.columns])


@query("aggregate_json")
def q_aggregate_json(spark, d):
    """The aggregates of every run as JSON, written and read back."""
    out = q_run_aggregates(spark, d)
    path = scratch_dir(spark, "aggregate-json")
    S.write_jsonl(out, path)
    return spark.read.schema(out.schema).json(path)


ORACLE["aggregate_json"] = ORACLE["run_aggregates"]


@query("report_samples", ctes=("sft_pairs", "predictions"), sql="""
SELECT 'eval_' || m.model_id AS evaluation_id, s.id, coalesce(s.instruction, '') AS instruction, coalesce(s.input, '') AS input,
       coalesce(s.output, '') AS reference, coalesce(p.prediction, '') AS prediction
FROM (SELECT *, unnest(['m0', 'm1', 'm2']) AS model_id FROM sft_pairs) s
JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS model_id) m ON s.model_id = m.model_id
LEFT JOIN predictions p ON s.reply_id = p.id AND s.model_id = p.model_id""")
def q_report_samples(spark, d):
    """A report row for every sample of every evaluation (no prediction: ''), written in one folder
    per evaluation id and read back."""
    samples = X.sft_pairs(spark, d).select(
        "id", "reply_id", "instruction", "input", F.col("output").alias("reference"),
        F.explode(F.array(*[F.lit(m) for m in X.MODELS])).alias("model_id"))
    p = preds(spark, d).select(F.col("id").alias("reply_id"), "model_id", "prediction")
    rows = M.pair_predictions(samples, p, ["reply_id", "model_id"])
    path = scratch_dir(spark, "report-samples")
    out = rows.select(F.concat(F.lit("eval_"), F.col("model_id")).alias("evaluation_id"), "id",
                      *[F.coalesce(c, F.lit("")).alias(c) for c in ("instruction", "input")], "reference", "prediction")
    S.write_jsonl(out, path, ["evaluation_id"])
    back = spark.read.schema("evaluation_id string, id string, instruction string, input string, reference string, prediction string").json(path)
    return back.select(*out.columns)


# ------------------------------------------------------------------ leaderboard
_LB = f"""
e AS (SELECT benchmark_id, dataset_id, model_id, upper(metric_name) AS metric_name,
             {rnd('metric_value', 4)} AS metric_value, metric_value AS raw, evaluated_at FROM bench_results),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, model_id
                                                  ORDER BY metric_value DESC, raw DESC, benchmark_id) AS k FROM e) q
      WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY metric_value DESC, raw DESC, model_id) AS rank
      FROM b),
lb AS (SELECT r.dataset_id, CAST(r.rank AS BIGINT) AS rank, r.model_id,
              coalesce(c.model_name, 'checkpoint-' || substr(r.model_id, 1, 8)) AS model_name,
              coalesce(c.base_model, 'N/A') AS base_model, r.metric_name, r.metric_value, r.evaluated_at
       FROM r LEFT JOIN checkpoints c ON r.model_id = c.checkpoint_id)"""


@query("leaderboard_entries", ctes=("bench_results",), sql="""
SELECT benchmark_id, model_id, metric_name, metric_value, evaluated_at
FROM bench_results WHERE dataset_id = 'd0'""")
def q_leaderboard_entries(spark, d):
    """L1: entries of one dataset, best first (a range sort; no position column)."""
    e = X.bench_results(spark, d).filter(F.col("dataset_id") == "d0").drop("dataset_id")
    return e.orderBy(F.col("metric_value").desc(), "benchmark_id")


@query("leaderboard_enriched", ctes=("bench_results", "checkpoints"), sql="""
SELECT b.benchmark_id, b.model_id, coalesce(c.model_name, 'checkpoint-' || substr(b.model_id, 1, 8)) AS model_name,
       coalesce(c.base_model, 'N/A') AS base_model
FROM bench_results b LEFT JOIN checkpoints c ON b.model_id = c.checkpoint_id""")
def q_leaderboard_enriched(spark, d):
    return L.enrich(X.bench_results(spark, d), X.checkpoints(spark, d)).select(
        "benchmark_id", "model_id", "model_name", "base_model")


@query("leaderboard", ctes=("bench_results", "checkpoints"), sql=f"WITH {_LB} SELECT * FROM lb")
def q_leaderboard(spark, d):
    return L.leaderboard(X.bench_results(spark, d), X.checkpoints(spark, d))


@query("leaderboard_topk", ctes=("bench_results", "checkpoints"), sql=f"WITH {_LB} SELECT * FROM lb WHERE rank <= 3")
def q_leaderboard_topk(spark, d):
    return L.leaderboard(X.bench_results(spark, d), X.checkpoints(spark, d), top_k=3)


@query("leaderboard_per_metric", ctes=("bench_results", "checkpoints"), sql=f"""
WITH {_LB.replace("PARTITION BY dataset_id, model_id", "PARTITION BY dataset_id, metric_name, model_id")
         .replace("PARTITION BY dataset_id ORDER", "PARTITION BY dataset_id, metric_name ORDER")}
SELECT dataset_id, metric_name, rank, model_id, model_name, base_model, metric_value, evaluated_at FROM lb""")
def q_leaderboard_per_metric(spark, d):
    return L.leaderboard(X.bench_results(spark, d), X.checkpoints(spark, d), per_metric=True)


@query("perf_matrix", ctes=("predictions",), sql=f"""
WITH s AS (SELECT model_id, avg(CAST(latency_ms AS DOUBLE)) AS lat,
                  sum(CAST(tokens AS DOUBLE)) / (sum(CAST(latency_ms AS DOUBLE)) / 1000) AS tps,
                  max(peak_memory_mb) AS peak_memory_mb
           FROM predictions GROUP BY model_id)
SELECT model_id, peak_memory_mb, {rnd('lat', 2)} AS avg_latency_ms, {rnd('tps', 2)} AS tokens_per_sec,
       {rnd(f'CAST({HOURLY_COST} AS DOUBLE) / 3600 / tps * 1000000', 4)} AS cost_per_1m_tokens FROM s""")
def q_perf_matrix(spark, d):
    return L.perf_matrix(preds(spark, d), HOURLY_COST)


@query("throughput_by_batch", ctes=("predictions",), sql=f"""
SELECT model_id, batch_size,
       {rnd('sum(CAST(tokens AS DOUBLE)) / (sum(CAST(latency_ms AS DOUBLE)) / 1000)', 2)} AS tokens_per_sec
FROM predictions GROUP BY model_id, batch_size""")
def q_throughput_by_batch(spark, d):
    return L.throughput_by_batch(preds(spark, d))


@query("throughput_pivot", ctes=("predictions",), sql=f"""
WITH t AS (SELECT model_id, batch_size,
                  {rnd('sum(CAST(tokens AS DOUBLE)) / (sum(CAST(latency_ms AS DOUBLE)) / 1000)', 2)} AS tps
           FROM predictions GROUP BY model_id, batch_size)
SELECT model_id, max(tps) FILTER (WHERE batch_size = 1) AS bs1, max(tps) FILTER (WHERE batch_size = 2) AS bs2,
       max(tps) FILTER (WHERE batch_size = 3) AS bs3, max(tps) FILTER (WHERE batch_size = 4) AS bs4
FROM t GROUP BY model_id""")
def q_throughput_pivot(spark, d):
    return L.throughput_pivot(preds(spark, d), [1, 2, 3, 4])
