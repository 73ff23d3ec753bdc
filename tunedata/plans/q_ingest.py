"""The ingest pipeline as one table per dataset: validate -> profile -> split sizes
-> lifecycle state, for many datasets at once; plus the remaining source round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import metrics as M
from tunedata.operators import profile as P
from tunedata.plans import fixtures as X
from tunedata.plans.q_audit import _counts_sql, _issues_sql
from tunedata.plans.q_catalog import _MJ, _metrics_text
from tunedata.plans.q_eval import _BLEU_SQL, _EM, KEYS, preds
from tunedata.plans.registry import query
from tunedata.plans.sqlfrag import est, rnd, strip
from tunedata.session import scratch_dir
from tunedata.sources import files as S

SPLIT = (0.8, 0.1, 0.1)


def repo_records(spark, d):
    """Instruction records of ``documents``, one dataset per (source, language) repository id."""
    docs = X.table(spark, d, "documents")
    first = F.substring_index(F.col("text"), "\n", 1)
    return docs.select(F.concat_ws("/", "source", "lang").alias("dataset_id"), first.alias("instruction"),
                       F.lit("").alias("input"),
                       F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("output"))


_REC = """
rec AS (SELECT source || '/' || lang AS dataset_id, split_part(text, chr(10), 1) AS instruction, '' AS input,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS output FROM documents)"""
_P = strip("coalesce(instruction, '') || ' ' || coalesce(input, '')")


@query("ingest_registry", sql=f"""
WITH {_REC}, {_counts_sql('rec', True)}, {_issues_sql()},
rep AS (SELECT k.dataset_id, count_if(i.severity = 'error') = 0 AS is_valid
        FROM k LEFT JOIN i ON k.dataset_id = i.dataset_id GROUP BY k.dataset_id),
pr AS (SELECT dataset_id, count(*) AS n, sum(length({_P})) AS pc, sum(length(coalesce(output, ''))) AS rc,
              sum({est(_P)} + {est("coalesce(output, '')")}) AS tok FROM rec GROUP BY dataset_id),
sz AS (SELECT dataset_id, CAST(round_even(CAST(0.8 AS DOUBLE) * n, 0) AS BIGINT) AS tr,
              CAST(least(n - round_even(CAST(0.8 AS DOUBLE) * n, 0), round_even(CAST(0.1 AS DOUBLE) * n, 0))
                   AS BIGINT) AS va FROM pr)
SELECT pr.dataset_id, replace(pr.dataset_id, '/', '_') AS dataset_name, 'huggingface:' || pr.dataset_id AS source,
       CASE WHEN rep.is_valid THEN 'ready' ELSE 'validated' END AS lifecycle_state, rep.is_valid,
       CAST(pr.n AS BIGINT) AS rows_count, k.dup AS duplicate_count,
       {rnd('(CAST(pc AS DOUBLE) / n)', 2)} AS avg_prompt_length,
       {rnd('(CAST(rc AS DOUBLE) / n)', 2)} AS avg_response_length,
       CAST(tok AS BIGINT) AS estimated_tokens,
       sz.tr AS train_rows, sz.va AS validation_rows, CAST(pr.n AS BIGINT) - sz.tr - sz.va AS test_rows
FROM pr JOIN rep ON pr.dataset_id = rep.dataset_id JOIN k ON pr.dataset_id = k.dataset_id
        JOIN sz ON pr.dataset_id = sz.dataset_id""")
def q_ingest_registry(spark, d):
    """Per dataset: validity, profile, exact split sizes, lifecycle state, provenance."""
    ap = P.audit_and_profile(repo_records(spark, d), "dataset_id")
    n = F.col("rows_count")
    tr = F.bround(F.lit(SPLIT[0]) * n, 0)
    va = F.least(n - tr, F.bround(F.lit(SPLIT[1]) * n, 0))
    name, source = S.provenance("dataset_id")
    return ap.select(
        "dataset_id", name.alias("dataset_name"), source.alias("source"),
        F.when(F.col("is_valid"), "ready").otherwise("validated").alias("lifecycle_state"), "is_valid",
        "rows_count", "duplicate_count", "avg_prompt_length", "avg_response_length", "estimated_tokens",
        tr.cast("long").alias("train_rows"), va.cast("long").alias("validation_rows"),
        (n - tr - va).cast("long").alias("test_rows"))


@query("read_jsonl_quarantine", sql=f"""
WITH {_MJ} SELECT event_id, user_id FROM mj WHERE json_valid(metrics_json)""")
def q_read_jsonl_quarantine(spark, d):
    """S2 (PERMISSIVE): a JSONL file with broken lines; good rows kept, broken ones quarantined."""
    mt = _metrics_text(spark, d)
    path = scratch_dir(spark, "jsonl-broken")
    # each line: the metrics text with the ids spliced in front of it (broken texts stay broken)
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id": '),
                    F.col("user_id").cast("string"), F.lit(", "),
                    F.expr("substr(metrics_json, 2)"))
    mt.select(line.alias("value")).write.text(path)
    good, _bad = S.read_jsonl_quarantine(spark, path, X.table(spark, d, "events").select("event_id", "user_id").schema)
    return good


@query("jsonl_error_lines", sql=f"""
WITH {_MJ}, n AS (SELECT *, event_id // {X.FILE_IDS} AS part, row_number() OVER (PARTITION BY event_id // {X.FILE_IDS} ORDER BY event_id) AS line FROM mj)
SELECT CAST(part AS BIGINT) AS part, CAST(line AS BIGINT) AS line, event_id FROM n WHERE NOT json_valid(metrics_json)""")
def q_jsonl_error_lines(spark, d):
    """The number of every malformed line in its file."""
    mt = _metrics_text(spark, d)
    path = scratch_dir(spark, "jsonl-lines")
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", "), F.expr("substr(metrics_json, 2)"))
    X.write_text_files(mt.select("event_id", line.alias("value")), "event_id", path)
    bad = S.malformed_lines(spark, path)
    return bad.select(X.part_of(), "line", F.regexp_extract("value", '"event_id": ([0-9]+)', 1).cast("long").alias("event_id"))


@query("scores_csv_roundtrip", ctes=("predictions",), sql=_BLEU_SQL + f"""
SELECT bl.id, bl.model_id, bl.bleu1, {_EM} AS exact_match
FROM bl JOIN predictions p ON bl.id = p.id AND bl.model_id = p.model_id""")
def q_scores_csv_roundtrip(spark, d):
    """Per-sample scores written as CSV (every field quoted) and read back."""
    sc = M.pair_scores(preds(spark, d), KEYS, ["bleu1", "exact_match"])
    path = scratch_dir(spark, "scores-csv")
    S.write_csv(sc, path)
    back = S.read_csv(spark, path)
    return back.select("id", "model_id", F.col("bleu1").cast("double").alias("bleu1"),
                       F.col("exact_match").cast("double").alias("exact_match"))

