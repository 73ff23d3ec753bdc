"""Operator inputs derived from the driver tables (see FIXTURES.md part B).

Each builder reads parquet tables lazily; Catalyst prunes the columns and
pushes filters into the scans.  ``SQL`` holds the same derivations as DuckDB
CTEs for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.functions.text import WS_RUN, tokens
from tunedata.operators.catalog import LIFECYCLE
from tunedata.plans.ordered import neighbour_by_stretch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def turn_id(turn: str = "turn") -> Column:
    """Text key of one turn: conversation and turn padded to 20 digits.

    No two turns share a key, however long a conversation is, and keys of numbers from 0 up
    sort like (conv_id, turn).
    """
    return F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 20, "0"), F.lpad(F.col(turn).cast("string"), 20, "0"))


def with_next_turn(turns: DataFrame, span: int = 1024) -> DataFrame:
    """``turns`` with ``next_turn``, ``next_role``, ``next_text`` of the next row in turn order (null at the end).

    Turns need not be dense; no window holds more than ``span`` turns of one conversation.
    """
    return neighbour_by_stretch(turns, ["conv_id"], ["turn"], ["turn", "role", "text"], F.floor(F.col("turn") / span))


def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn + the assistant's reply (output) + the conversation's system text (input).

    The reply is the next row in turn order if an assistant says it; ``reply_id`` is its key.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return pairs_of(c)


def pairs_of(c: DataFrame) -> DataFrame:
    """``sft_pairs`` of turn rows (conv_id, turn, role, text)."""
    system = (c.filter(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("input")))
    users = with_next_turn(c).filter(F.col("role") == "user")
    reply = F.col("next_role") == "assistant"
    return (users.join(system, "conv_id", "left")
            .select(turn_id().alias("id"), "conv_id", "turn",
                    F.col("text").alias("instruction"), "input", F.when(reply, F.col("next_text")).alias("output"),
                    F.when(reply, turn_id("next_turn")).alias("reply_id")))


def sft_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document -> first line as instruction, the rest as output."""
    d = table(spark, sf_dir, "documents")
    first = F.substring_index(F.col("text"), "\n", 1)
    return d.select(F.col("doc_id").alias("id"), "source", first.alias("instruction"),
                    F.lit("").alias("input"),
                    F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("output"))


#: the synthetic models of ``predictions``
MODELS = ("m0", "m1", "m2")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three synthetic models over assistant turns; model m replaces every (5-m)-th word."""
    a = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    tok = tokens("text")
    m = F.col("m")
    pred = F.array_join(F.transform(tok, lambda x, i: F.when(((i + F.col("turn")) % (5 - m)) == 0,
                                                                F.lit("unk")).otherwise(x)), " ")
    n = F.size(tok).cast("long")
    return (a.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
            .select(turn_id().alias("id"), "conv_id", "turn",
                    F.concat(F.lit("m"), m.cast("string")).alias("model_id"),
                    F.coalesce(F.col("text"), F.lit("")).alias("reference"),
                    pred.alias("prediction"),
                    n.alias("tokens"),
                    (100 + 10 * m + (2 + m) * n).cast("long").alias("latency_ms"),
                    (1000 + 50 * m + 2 * n).cast("long").alias("peak_memory_mb"),
                    (1 + F.col("turn") % 4).cast("long").alias("batch_size")))


def class_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("model_id"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("reference"),
        F.when(F.col("n_chars") < 60, "unknown").when(F.col("n_chars") >= 400, " Good")
        .otherwise("BAD ").alias("prediction"))


def bench_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("benchmark_id"),
        F.concat(F.lit("d"), (F.col("event_id") % 5).cast("string")).alias("dataset_id"),
        F.concat(F.lit("ckpt"), F.col("user_id").cast("string")).alias("model_id"),
        F.when(F.col("event_type").isin("click", "view"), "bleu").otherwise("accuracy").alias("metric_name"),
        (F.col("value") / 1000).alias("metric_value"),
        F.col("ts").alias("evaluated_at"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered checkpoints: customers with a non-negative balance (the rest are unknown)."""
    c = table(spark, sf_dir, "customer")
    return c.filter(F.col("c_acctbal") >= 0).select(
        F.concat(F.lit("ckpt"), F.col("c_custkey").cast("string")).alias("checkpoint_id"),
        F.col("c_name").alias("model_name"), F.col("c_mktsegment").alias("base_model"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tags"),
        F.col("c_custkey").alias("registered_seq"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = (F.when(F.col("event_type") == "signup", "pending")
             .when(F.col("event_type") == "purchase", "completed")
             .when(F.col("event_type") == "error", "failed").otherwise("running"))
    return e.select(
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("version"), "ts", state.alias("state"),
        F.concat(F.lit("ds"), (F.col("user_id") + 1).cast("string")).alias("dataset_id"),
        F.floor("value").cast("int").alias("step"), F.lit(500).alias("total_steps"))


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries of every run; the step is a column of the log (its entry number), not a rank."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("step"), "ts", "event_id",
        F.when(F.col("event_type") != "view", F.col("value") / 100).alias("loss"),
        F.when(F.col("event_type") == "view", F.col("value") / 100).alias("eval_loss"))


def param_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy("user_id", "event_type")
            .agg(F.max(F.get_json_object("props", "$.k").cast("int")).alias("value"))
            .select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
                    F.concat(F.lit("p_"), F.col("event_type")).alias("key"), "value"))




def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of datasets (legal and illegal ones); ``event_id`` numbers the log."""
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.array(*[F.lit(s) for s in LIFECYCLE]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.concat(F.lit("ds"), F.col("user_id").cast("string")).alias("dataset_id"),
                    "ts", "event_id", (F.col("event_id") % 6).cast("long").alias("ord"), state.alias("state"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn-per-row conversations regrouped into chat records (one row per conversation).

    A chat record is one training example, so its turns belong together; the
    sort happens inside the record, not over the table.
    """
    c = table(spark, sf_dir, "conversations")
    return (c.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"),
                                                                      t["text"].alias("content")))
                    .alias("messages")))


#: consecutive ids that share one text file of ``write_text_files``
FILE_IDS = 1000


def write_text_files(lines: DataFrame, id_col: str, path: str) -> None:
    """Column ``value`` as text files ``part=<k>`` of ``FILE_IDS`` ids each, in the order of the ids."""
    parts = lines.withColumn("part", F.floor(F.col(id_col) / FILE_IDS)).repartition("part").sortWithinPartitions("part", id_col)
    parts.select("part", "value").write.partitionBy("part").text(path)


def part_of(file: str = "file") -> Column:
    return F.regexp_extract(file, "part=([0-9]+)", 1).cast("long").alias("part")


# ---------------------------------------------------------------- oracle CTEs
_WS = WS_RUN


def _sql_id(conv: str, turn: str) -> str:
    return f"lpad(CAST({conv} AS VARCHAR), 20, '0') || ':' || lpad(CAST({turn} AS VARCHAR), 20, '0')"


SQL = {
    "sft_pairs": f"""
sft_pairs AS (
  WITH t AS (
    SELECT conv_id, turn, role, text,
           lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
    FROM conversations),
  s AS (SELECT conv_id, min_by(text, turn) AS input FROM conversations WHERE role = 'system' GROUP BY conv_id)
  SELECT {_sql_id('t.conv_id', 't.turn')} AS id, t.conv_id, t.turn, t.text AS instruction, s.input,
         CASE WHEN nr = 'assistant' THEN nt END AS output,
         CASE WHEN nr = 'assistant' THEN {_sql_id('t.conv_id', 't.nx')} END AS reply_id
  FROM t LEFT JOIN s ON t.conv_id = s.conv_id WHERE role = 'user')""",
    "sft_docs": """
sft_docs AS (
  SELECT doc_id AS id, source, split_part(text, chr(10), 1) AS instruction, '' AS input,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS output
  FROM documents)""",
    "predictions": f"""
predictions AS (
  SELECT {_sql_id('conv_id', 'turn')} AS id, conv_id, turn, 'm' || CAST(m AS VARCHAR) AS model_id,
         coalesce(text, '') AS reference,
         array_to_string(list_transform(tk, lambda x, i: CASE WHEN (i - 1 + turn) % (5 - m) = 0
                                                         THEN 'unk' ELSE x END), ' ') AS prediction,
         CAST(len(tk) AS BIGINT) AS tokens,
         CAST(100 + 10 * m + (2 + m) * len(tk) AS BIGINT) AS latency_ms,
         CAST(1000 + 50 * m + 2 * len(tk) AS BIGINT) AS peak_memory_mb,
         CAST(1 + turn % 4 AS BIGINT) AS batch_size
  FROM (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS tk
        FROM conversations WHERE role = 'assistant') a
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) mm)""",
    "class_pred": """
class_pred AS (
  SELECT d.doc_id AS id, d.lang AS model_id,
         CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS reference,
         CASE WHEN d.n_chars < 60 THEN 'unknown' WHEN d.n_chars >= 400 THEN ' Good' ELSE 'BAD ' END AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "bench_results": """
bench_results AS (
  SELECT 'b' || CAST(event_id AS VARCHAR) AS benchmark_id, 'd' || CAST(event_id % 5 AS VARCHAR) AS dataset_id,
         'ckpt' || CAST(user_id AS VARCHAR) AS model_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'bleu' ELSE 'accuracy' END AS metric_name,
         value / 1000 AS metric_value, ts AS evaluated_at
  FROM events)""",
    "checkpoints": """
checkpoints AS (
  SELECT 'ckpt' || CAST(c_custkey AS VARCHAR) AS checkpoint_id, c_name AS model_name,
         c_mktsegment AS base_model,
         [lower(c_mktsegment), 'n' || CAST(c_nationkey AS VARCHAR)] AS tags,
         c_custkey AS registered_seq
  FROM customer WHERE c_acctbal >= 0)""",
    "job_log": """
job_log AS (
  SELECT 'job' || CAST(user_id AS VARCHAR) AS job_id, event_id AS version, ts,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' ELSE 'running' END AS state,
         'ds' || CAST(user_id + 1 AS VARCHAR) AS dataset_id,
         CAST(floor(value) AS INTEGER) AS step, 500 AS total_steps
  FROM events)""",
    "metric_history": """
metric_history AS (
  SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id,
         event_id AS step, ts, event_id,
         CASE WHEN event_type <> 'view' THEN value / 100 END AS loss,
         CASE WHEN event_type = 'view' THEN value / 100 END AS eval_loss
  FROM events)""",
    "param_log": """
param_log AS (
  SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id, 'p_' || event_type AS key,
         max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS value
  FROM events GROUP BY user_id, event_type)""",
    "lifecycle_log": """
lifecycle_log AS (
  SELECT 'ds' || CAST(user_id AS VARCHAR) AS dataset_id, ts, event_id, CAST(event_id % 6 AS BIGINT) AS ord,
         CASE event_id % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'validated' WHEN 2 THEN 'profiled'
                           WHEN 3 THEN 'split' WHEN 4 THEN 'registered' ELSE 'ready' END AS state
  FROM events)""",
    "conversation_messages": """
conversation_messages AS (
  SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages
  FROM conversations GROUP BY conv_id)""",
}

# CTE dependencies (a CTE that reads another one lists it here).
SQL_DEPS: dict[str, list[str]] = {}


def with_ctes(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named fixture CTEs."""
    seen: list[str] = []

    def add(n):
        for d in SQL_DEPS.get(n, []):
            add(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        add(n)
    if not seen:
        return body
    head = "WITH " + ",".join(SQL[n] for n in seen)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body
