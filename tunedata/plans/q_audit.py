"""Queries for validation (V) and profiling (P)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunedata.functions.text import estimate_tokens, word_count
from tunedata.operators import profile as P
from tunedata.operators import validate as V
from tunedata.plans import fixtures as X
from tunedata.plans.registry import query
from tunedata.session import scratch_dir
from tunedata.plans.sqlfrag import est, missing, rnd, strip, toks


def pair_records(spark, d):
    """Instruction records as the reference sees them: {instruction, input, output}."""
    return X.sft_pairs(spark, d).select("instruction", "input", "output")


def doc_records(spark, d):
    """Many datasets in one table: records of ``sft_docs`` keyed by source."""
    return X.sft_docs(spark, d).select(F.col("source").alias("dataset_id"), "instruction", "input", "output")


PAIR_REC = "(SELECT instruction, input, output FROM sft_pairs)"
DOC_REC = "(SELECT source AS dataset_id, instruction, input, output FROM sft_docs)"


def _counts_sql(rec: str, grouped: bool, has_output: bool = True) -> str:
    g = "dataset_id" if grouped else "'dataset' AS dataset_id"
    gb = "GROUP BY dataset_id" if grouped else ""
    cols = "dataset_id, instruction, input" + (", output" if has_output else "")
    out = "output" if has_output else "CAST(NULL AS VARCHAR)"
    inner_sel = cols if grouped else cols.replace("dataset_id, ", "")
    dup_group = "dataset_id" if grouped else "'dataset'"
    return f"""
c AS (SELECT {g}, count(*) AS n_rows,
             count_if({missing('instruction')}) AS mi, count_if({missing(out)}) AS mo,
             count_if({missing('input')}) AS mn
      FROM {rec} r {gb}),
dd AS (SELECT {dup_group} AS dataset_id, CAST(sum(k - 1) AS BIGINT) AS dup
       FROM (SELECT {inner_sel}, count(*) AS k FROM {rec} r GROUP BY ALL) q {'GROUP BY dataset_id' if grouped else ''}),
k AS (SELECT c.*, dd.dup FROM c JOIN dd USING (dataset_id))"""


def _issues_sql(has_output: bool = True) -> str:
    hdr = "" if has_output else """
  SELECT dataset_id, 2 AS o, 'error' AS severity,
         'Dataset lacks required fine-tuning column header: ''output''' AS message,
         'output' AS affected_field FROM k WHERE n_rows > 0 UNION ALL"""
    return f"""
i AS ({hdr}
  SELECT dataset_id, 3 AS o, CASE WHEN mi = n_rows THEN 'error' ELSE 'warning' END AS severity,
         'Found ' || mi || ' records with null or empty ''instruction'' fields.' AS message,
         'instruction' AS affected_field
  FROM k WHERE mi > 0 AND n_rows > 0
  UNION ALL
  SELECT dataset_id, 4, CASE WHEN mo = n_rows THEN 'error' ELSE 'warning' END,
         'Found ' || mo || ' records with null or empty ''output'' fields.', 'output'
  FROM k WHERE mo > 0 AND n_rows > 0
  UNION ALL
  SELECT dataset_id, 5, 'warning', 'Found ' || dup || ' duplicate row entries.', 'records'
  FROM k WHERE dup > 0 AND n_rows > 0
  UNION ALL
  SELECT dataset_id, 6, 'info',
         'Found ' || mn || ' records with empty or omitted optional ''input'' values.', 'input'
  FROM k WHERE mn > 0 AND n_rows > 0)"""


# ------------------------------------------------------------------ validation
@query("missing_counts", ctes=("sft_pairs",), sql=f"""
SELECT count(*) AS n_rows, CAST(count_if({missing('instruction')}) AS BIGINT) AS missing_instruction,
       CAST(count_if({missing('output')}) AS BIGINT) AS missing_output,
       CAST(count_if({missing('input')}) AS BIGINT) AS missing_input
FROM sft_pairs""")
def q_missing_counts(spark, d):
    return V.missing_counts(pair_records(spark, d))


@query("duplicate_count", ctes=("sft_docs",), sql=f"""
SELECT dataset_id, CAST(sum(k - 1) AS BIGINT) AS duplicate_count
FROM (SELECT dataset_id, instruction, input, output, count(*) AS k FROM {DOC_REC} r GROUP BY ALL) q
GROUP BY dataset_id""")
def q_duplicate_count(spark, d):
    return V.duplicate_count(doc_records(spark, d), "dataset_id")


@query("validation_issues", ctes=("sft_docs",), sql=f"""
WITH {_counts_sql(DOC_REC, True)}, {_issues_sql()}
SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY o) - 1 AS INTEGER) AS issue_no,
       severity, message, affected_field
FROM i""")
def q_validation_issues(spark, d):
    return V.validation_issues(doc_records(spark, d), "dataset_id")


@query("validation_issues_pairs", ctes=("sft_pairs",), sql=f"""
WITH {_counts_sql(PAIR_REC, False)}, {_issues_sql()}
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS issue_no, severity, message, affected_field
FROM i""")
def q_validation_issues_pairs(spark, d):
    return V.validation_issues(pair_records(spark, d))


@query("validate_headers", ctes=("sft_docs",), sql=f"""
WITH {_counts_sql("(SELECT source AS dataset_id, instruction, input FROM sft_docs)", True, False)},
{_issues_sql(False)}
SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY o) - 1 AS INTEGER) AS issue_no,
       severity, message, affected_field
FROM i""")
def q_validate_headers(spark, d):
    return V.validation_issues(doc_records(spark, d).drop("output"), "dataset_id")


def _report_sql(catalog: bool) -> str:
    cat = """
cat AS (SELECT DISTINCT dataset_id FROM job_log UNION SELECT DISTINCT dataset_id FROM k),""" if catalog else """
cat AS (SELECT dataset_id FROM k),"""
    empty = """
  UNION ALL SELECT dataset_id, 1, 'error' FROM cat WHERE dataset_id NOT IN (SELECT dataset_id FROM k)"""
    return f"""
WITH {_counts_sql(DOC_REC, True)}, {_issues_sql()},{cat}
ii AS (SELECT dataset_id, o, severity FROM i {empty if catalog else ''})
SELECT cat.dataset_id, coalesce(count_if(severity = 'error'), 0) = 0 AS is_valid,
       CAST(count(severity) AS BIGINT) AS n_issues,
       CAST(count_if(severity = 'error') AS BIGINT) AS n_errors,
       CAST(count_if(severity = 'warning') AS BIGINT) AS n_warnings,
       CAST(count_if(severity = 'info') AS BIGINT) AS n_info
FROM cat LEFT JOIN ii ON cat.dataset_id = ii.dataset_id GROUP BY cat.dataset_id"""


@query("validation_report", ctes=("sft_docs",), sql=_report_sql(False))
def q_validation_report(spark, d):
    return V.validation_report(doc_records(spark, d), "dataset_id")


def _catalog(spark, d):
    jobs = X.job_log(spark, d).select("dataset_id")
    return jobs.unionByName(doc_records(spark, d).select("dataset_id"))


@query("validate_empty", ctes=("sft_docs", "job_log"), sql=_report_sql(True))
def q_validate_empty(spark, d):
    return V.validation_report(doc_records(spark, d), "dataset_id", catalog=_catalog(spark, d))


@query("ingest_gate", ctes=("sft_docs",), sql=f"""
WITH rep AS ({_report_sql(False)})
SELECT dataset_id, is_valid, CASE WHEN is_valid THEN 'ready' ELSE 'validated' END AS final_state FROM rep""")
def q_ingest_gate(spark, d):
    return V.ingest_gate(V.validation_report(doc_records(spark, d), "dataset_id"), "dataset_id")


def _chat_audit_sql(turns: str) -> str:
    return f"""
t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS INTEGER)
        AS turn_index, role, text FROM {turns}),
rec AS (SELECT conv_id, count(*) AS n FROM {turns} GROUP BY conv_id)
SELECT conv_id, 'too_few_turns' AS rule, CAST(NULL AS INTEGER) AS turn_index FROM rec WHERE n < 2
UNION ALL SELECT conv_id, 'missing_role_or_content', turn_index FROM t WHERE role IS NULL OR text IS NULL
UNION ALL SELECT conv_id, 'invalid_role', turn_index FROM t
          WHERE role IS NOT NULL AND role NOT IN ('system', 'user', 'assistant')
UNION ALL SELECT conv_id, 'blank_content', turn_index FROM t WHERE text IS NOT NULL AND {strip('text')} = ''"""


@query("chat_schema_audit", sql="WITH " + _chat_audit_sql("conversations"))
def q_chat_schema_audit(spark, d):
    return V.chat_turn_violations_long(X.table(spark, d, "conversations"), "conv_id")


@query("chat_broken_turns_audit", sql="""
WITH broken AS (SELECT CASE WHEN conv_id % 9 <> 4 THEN conv_id END AS conv_id, CASE WHEN (conv_id + 5 * turn) % 7 <> 3 THEN turn END AS turn,
  CASE (conv_id * 3 + turn) % 13 WHEN 2 THEN 'tool' WHEN 5 THEN NULL ELSE role END AS role,
  CASE (conv_id * 5 + turn) % 11 WHEN 2 THEN chr(10) || '  ' WHEN 5 THEN NULL ELSE text END AS text
  FROM conversations WHERE conv_id % 10 <> 7 OR turn = 0),
""" + _chat_audit_sql("broken"))
def q_chat_broken_turns_audit(spark, d):
    """V7 on turn rows with faults: no conversation id, no number, other or no roles, blank or no text, single turns."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = X.table(spark, d, "conversations").where((c % 10 != 7) | (t == 0))
    role, text = (c * 3 + t) % 13, (c * 5 + t) % 11
    rows = rows.select(F.when(c % 9 != 4, c).alias("conv_id"), F.when((c + 5 * t) % 7 != 3, t).alias("turn"),
                       F.when(role == 2, "tool").when(role != 5, F.col("role")).alias("role"),
                       F.when(text == 2, "\n  ").when(text != 5, F.col("text")).alias("text"))
    return V.chat_turn_violations_long(rows, "conv_id")


@query("chat_schema_audit_records", sql="WITH " + _chat_audit_sql("conversations"))
def q_chat_schema_audit_records(spark, d):
    """V7 on chat records (``messages`` arrays)."""
    return V.chat_turn_violations(X.conversation_messages(spark, d), "conv_id")


#: one broken record of each kind by conv_id % 20: (text put in place of the messages, or turn added to them; rule)
_BROKEN_RECORDS = {0: ('{"messages": [', "invalid_json"), 1: ('{"turns": []}', "missing_messages"),
                   2: ('{"messages": null}', "messages_not_list"), 3: ('{"messages": {"role": "user"}}', "messages_not_list"),
                   4: ('{"messages": []}', "too_few_turns"),
                   5: ('{"messages": [{"role": "user", "content": "alone"}]}', "too_few_turns")}
_BROKEN_TURNS = {6: ("7", "turn_not_object"), 7: ("null", "turn_not_object"), 8: ('{"role": "user"}', "missing_role_or_content"),
                 9: ('{"role": "tool", "content": "x"}', "invalid_role"), 10: ('{"role": null, "content": "x"}', "invalid_role"),
                 11: ('{"role": "user", "content": 42}', "content_not_string"),
                 12: ('{"role": "user", "content": {"t": 1}}', "content_not_string"),
                 13: ('{"role": "user", "content": null}', "content_not_string"),
                 14: ('{"role": "user", "content": " \\t"}', "blank_content")}


def _cases(cases: dict) -> str:
    return "CASE conv_id % 20 " + " ".join(f"WHEN {k} THEN '{rule}'" for k, (_, rule) in cases.items()) + " END"


_RAW_SQL = f"""
t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index,
                  role, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id),
k AS (SELECT * FROM t WHERE conv_id % 20 > 5 AND n + (conv_id % 20 < 15)::INT >= 2),
broken AS (
SELECT conv_id, {_cases(_BROKEN_RECORDS)} AS rule, CAST(NULL AS INTEGER) AS turn_index FROM c WHERE conv_id % 20 <= 5
UNION ALL SELECT conv_id, 'too_few_turns', NULL FROM c WHERE conv_id % 20 >= 15 AND n < 2
UNION ALL SELECT conv_id, {_cases(_BROKEN_TURNS)}, n FROM c WHERE conv_id % 20 BETWEEN 6 AND 14
UNION ALL SELECT conv_id, 'missing_role_or_content', turn_index FROM k WHERE role IS NULL OR text IS NULL
UNION ALL SELECT conv_id, 'invalid_role', turn_index FROM k WHERE role NOT IN ('system', 'user', 'assistant')
UNION ALL SELECT conv_id, 'blank_content', turn_index FROM k WHERE {strip('text')} = '')"""


def _raw_records(spark, d):
    """(conv_id, value): one JSON line per conversation, most with one fault."""
    kind = F.col("conv_id") % 20

    def case(cases: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, (text, _) in cases.items() for x in (k, text)]), kind.cast("int"))
    added = F.concat(F.expr("substr(_m, 1, length(_m) - 1)"), F.lit(","), case(_BROKEN_TURNS), F.lit("]"))
    lines = X.conversation_messages(spark, d).withColumn("_m", F.to_json("messages"))
    whole = F.concat(F.lit('{"messages": '), F.coalesce(added, F.col("_m")), F.lit("}"))
    return lines.select("conv_id", F.coalesce(case(_BROKEN_RECORDS), whole).alias("value"))


@query("chat_raw_audit", sql=f"WITH {_RAW_SQL} SELECT * FROM broken UNION ALL SELECT NULL, 'empty_file', NULL")
def q_chat_raw_audit(spark, d):
    """V7, V9 on raw JSONL files: one line per conversation, most with one fault, and an empty file."""
    lines = _raw_records(spark, d).select(F.concat(F.col("conv_id").cast("string"), F.lit("\t"), F.col("value")).alias("value"))
    path = scratch_dir(spark, "chat-raw")
    lines.write.text(f"{path}/records")
    lines.limit(0).coalesce(1).write.text(f"{path}/empty")
    raw = spark.read.text(f"{path}/records").where("value <> ''")
    keyed = raw.select(F.expr("substr(value, 1, instr(value, '\t') - 1)").cast("long").alias("conv_id"),
                       F.expr("substr(value, instr(value, '\t') + 1)").alias("value"))
    broken = V.chat_text_violations(keyed, "conv_id")
    empty = V.empty_files(spark, f"{path}/empty").select(F.lit(None).cast("long").alias("conv_id"), F.lit("empty_file").alias("rule"),
                                                         F.lit(None).cast("int").alias("turn_index"))
    return broken.unionByName(empty)


@query("chat_file_audit", sql=f"""
WITH {_RAW_SQL}, f AS (SELECT conv_id, conv_id // {X.FILE_IDS} AS part,
  row_number() OVER (PARTITION BY conv_id // {X.FILE_IDS} ORDER BY conv_id) AS line FROM c)
SELECT CAST(part AS BIGINT) AS part, CAST(line AS BIGINT) AS line, rule, turn_index FROM broken JOIN f ON broken.conv_id = f.conv_id""")
def q_chat_file_audit(spark, d):
    """V7 on JSONL files: file and line number of every rule broken."""
    path = scratch_dir(spark, "chat-files")
    X.write_text_files(_raw_records(spark, d), "conv_id", path)
    return V.chat_file_violations(spark, path).select(X.part_of(), "line", "rule", "turn_index")


# ------------------------------------------------------------------- profiling
_PROMPT = strip("coalesce(instruction, '') || ' ' || coalesce(input, '')")


def _profile_sql(rec: str, grouped: bool) -> str:
    g = "dataset_id" if grouped else "'dataset' AS dataset_id"
    gb = "GROUP BY dataset_id" if grouped else ""
    p = strip("coalesce(instruction, '') || ' ' || coalesce(input, '')")
    sel_g = "s.dataset_id, " if grouped else ""
    return f"""
WITH s AS (SELECT {g}, count(*) AS n, sum(length({p})) AS pc, sum(length(coalesce(output, ''))) AS rc,
                  sum({est(p)} + {est("coalesce(output, '')")}) AS tok
           FROM {rec} r {gb}),
dd AS (SELECT {'dataset_id' if grouped else "'dataset'"} AS dataset_id, CAST(sum(k - 1) AS BIGINT) AS dup
       FROM (SELECT *, count(*) AS k FROM {rec} r GROUP BY ALL) q {'GROUP BY dataset_id' if grouped else ''})
SELECT {sel_g}CAST(n AS BIGINT) AS rows_count, 'input,instruction,output' AS columns,
       dd.dup AS duplicate_count,
       {rnd('CAST(pc AS DOUBLE) / n', 2)} AS avg_prompt_length,
       {rnd('CAST(rc AS DOUBLE) / n', 2)} AS avg_response_length,
       CAST(tok AS BIGINT) AS estimated_tokens
FROM s JOIN dd USING (dataset_id)"""


@query("profile", ctes=("sft_pairs",), sql=_profile_sql(PAIR_REC, False))
def q_profile(spark, d):
    return P.profile(pair_records(spark, d))


@query("profile_by_source", ctes=("sft_docs",), sql=_profile_sql(DOC_REC, True))
def q_profile_by_source(spark, d):
    return P.profile(doc_records(spark, d), "dataset_id")


@query("profile_missing", ctes=("sft_pairs",), sql=f"""
SELECT 'input' AS "column", CAST(count_if({missing('input')}) AS BIGINT) AS missing FROM sft_pairs
UNION ALL SELECT 'instruction', CAST(count_if({missing('instruction')}) AS BIGINT) FROM sft_pairs
UNION ALL SELECT 'output', CAST(count_if({missing('output')}) AS BIGINT) FROM sft_pairs""")
def q_profile_missing(spark, d):
    return P.profile_missing(pair_records(spark, d))


@query("profile_lengths", ctes=("sft_docs",), sql=f"""
SELECT source AS dataset_id, count(*) AS rows_count,
       {rnd(f"CAST(sum(length({_PROMPT})) AS DOUBLE) / count(*)", 2)} AS avg_prompt_length,
       {rnd("CAST(sum(length(coalesce(output, ''))) AS DOUBLE) / count(*)", 2)} AS avg_response_length
FROM sft_docs GROUP BY source""")
def q_profile_lengths(spark, d):
    return P.profile_lengths(doc_records(spark, d), "dataset_id")


@query("token_estimate", sql=f"""
SELECT doc_id, CAST(len({toks('text')}) AS INTEGER) AS n_words, {est('text')} AS est_tokens FROM documents""")
def q_token_estimate(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", word_count("text").alias("n_words"), estimate_tokens("text").alias("est_tokens"))
