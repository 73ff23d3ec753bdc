"""Queries for cleaning / splitting (C) and formatting (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import chat as H
from tunedata.operators import clean as C
from tunedata.operators import split as S
from tunedata.plans import fixtures as X
from tunedata.plans.registry import query
from tunedata.plans.sqlfrag import strip

# ------------------------------------------------------------------ SQL pieces
_CLEAN_DOCS = f"""
cl0 AS (SELECT id, source, {strip('CAST(instruction AS VARCHAR)')} AS instruction,
               {strip("coalesce(CAST(input AS VARCHAR), '')")} AS input,
               {strip('CAST(output AS VARCHAR)')} AS output
        FROM sft_docs WHERE instruction IS NOT NULL AND output IS NOT NULL),
cl AS (SELECT * FROM cl0 WHERE id IN (SELECT min(id) FROM cl0 GROUP BY instruction, output, input))"""

_CLEAN_PAIRS = f"""
cp0 AS (SELECT id, {strip('CAST(instruction AS VARCHAR)')} AS instruction,
               {strip("coalesce(CAST(input AS VARCHAR), '')")} AS input,
               {strip('CAST(output AS VARCHAR)')} AS output
        FROM sft_pairs WHERE instruction IS NOT NULL AND output IS NOT NULL),
cp AS (SELECT * FROM cp0 WHERE id IN (SELECT min(id) FROM cp0 GROUP BY instruction, output, input))"""


def _split3_sql(src: str, seed: int = 42, tr: float = 0.8, va: float = 0.1) -> str:
    return f"""
rk AS (SELECT id, row_number() OVER (ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) - 1 AS r,
              count(*) OVER () AS n FROM {src}),
sp AS (SELECT id, CASE WHEN r < round_even(CAST({tr} AS DOUBLE) * n, 0) THEN 'train'
                       WHEN r < least(n, round_even(CAST({tr} AS DOUBLE) * n, 0)
                                        + round_even(CAST({va} AS DOUBLE) * n, 0)) THEN 'validation'
                       ELSE 'test' END AS split FROM rk)"""


def _split2_sql(src: str, seed: int = 42, test_size: float = 0.2) -> str:
    return f"""
rk2 AS (SELECT id, row_number() OVER (ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) - 1 AS r,
               count(*) OVER () AS n FROM {src}),
sp2 AS (SELECT id, CASE WHEN r < n - ceil(CAST({test_size} AS DOUBLE) * n) THEN 'train'
                        ELSE 'validation' END AS split FROM rk2)"""


def clean_docs(spark, d):
    return C.clean_instructions(X.sft_docs(spark, d))


def clean_pairs(spark, d):
    return C.clean_instructions(X.sft_pairs(spark, d).drop("conv_id", "turn", "reply_id"))


# -------------------------------------------------------------------- cleaning
@query("clean_dropna", ctes=("sft_pairs",), sql="""
SELECT id, instruction, input, output FROM sft_pairs WHERE instruction IS NOT NULL AND output IS NOT NULL""")
def q_clean_dropna(spark, d):
    return C.drop_null(C.map_columns(X.sft_pairs(spark, d).select("id", "instruction", "input", "output")))


@query("clean_strip", ctes=("sft_pairs",), sql=f"WITH {_CLEAN_PAIRS} SELECT * FROM cp0")
def q_clean_strip(spark, d):
    p = X.sft_pairs(spark, d).select("id", "instruction", "input", "output")
    return C.strip_fields(C.drop_null(C.map_columns(p))).select("id", "instruction", "input", "output")


@query("dedup_keep_first", ctes=("sft_docs",), sql="""
SELECT id, source, instruction, input, output FROM sft_docs
WHERE id IN (SELECT min(id) FROM sft_docs GROUP BY instruction, output, input)""")
def q_dedup_keep_first(spark, d):
    return C.dedup_keep_first(X.sft_docs(spark, d))


@query("clean_instructions", ctes=("sft_docs",), sql=f"WITH {_CLEAN_DOCS} SELECT * FROM cl")
def q_clean_instructions(spark, d):
    return clean_docs(spark, d).select("id", "source", "instruction", "input", "output")


@query("cleaning_funnel", ctes=("sft_docs",), sql=f"""
WITH {_CLEAN_DOCS}
SELECT (SELECT count(*) FROM sft_docs) AS initial_rows, (SELECT count(*) FROM cl0) AS null_free_rows,
       (SELECT count(*) FROM cl0) - (SELECT count(*) FROM cl) AS duplicates_removed,
       (SELECT count(*) FROM cl) AS final_rows,
       CAST((SELECT count(*) FROM cl) - ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM cl)) AS BIGINT) AS train_rows,
       CAST(ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM cl)) AS BIGINT) AS validation_rows""")
def q_cleaning_funnel(spark, d):
    return C.cleaning_funnel(X.sft_docs(spark, d))


# ------------------------------------------------------------------- splitting
@query("split_three_way", ctes=("sft_docs",), sql=f"WITH {_CLEAN_DOCS}, {_split3_sql('cl')} SELECT * FROM sp")
def q_split_three_way(spark, d):
    return S.three_way_split(clean_docs(spark, d)).select("id", "split")


@query("split_sizes", ctes=("sft_docs",), sql=f"""
WITH {_CLEAN_DOCS}, {_split3_sql('cl')} SELECT split, count(*) AS n_rows FROM sp GROUP BY split""")
def q_split_sizes(spark, d):
    return S.split_sizes(S.three_way_split(clean_docs(spark, d)))


@query("split_two_way", ctes=("sft_pairs",), sql=f"WITH {_CLEAN_PAIRS}, {_split2_sql('cp')} SELECT * FROM sp2")
def q_split_two_way(spark, d):
    return S.two_way_split(clean_pairs(spark, d)).select("id", "split")


@query("split_overlap", ctes=("sft_docs",), sql="""
SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS split_a, CAST(NULL AS VARCHAR) AS split_b
FROM sft_docs WHERE false""")
def q_split_overlap(spark, d):
    """C11: the same seed over differently partitioned inputs gives the same split."""
    docs = clean_docs(spark, d)
    a = S.three_way_split(docs.repartition(7))
    b = S.three_way_split(docs.repartition(3))
    return S.split_overlap(a, b)


@query("split_hash_mode", ctes=("sft_docs",), sql="""
SELECT id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT id, CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 13))::BIGINT AS DOUBLE)
                 / CAST(16 ** 13 AS DOUBLE) AS u FROM sft_docs)""")
def q_split_hash_mode(spark, d):
    return S.hash_split(X.sft_docs(spark, d)).select("id", "split")


# ------------------------------------------------------------------ formatting
_MSG_SQL = f"""
WITH {_CLEAN_PAIRS},
m AS (SELECT id, 0 AS pos, 'system' AS role, 'You are a helpful assistant.' AS content FROM cp
      UNION ALL SELECT id, 1, 'user', CASE WHEN coalesce(input, '') <> ''
                                       THEN instruction || chr(10) || chr(10) || 'Context:' || chr(10) || input
                                       ELSE instruction END FROM cp
      UNION ALL SELECT id, 2, 'assistant', output FROM cp)
SELECT id, CAST(pos AS INTEGER) AS pos, role, content FROM m"""


@query("chat_messages", ctes=("sft_pairs",), sql=_MSG_SQL)
def q_chat_messages(spark, d):
    m = H.chat_messages(clean_pairs(spark, d))
    return m.select("id", F.posexplode("messages").alias("pos", "msg")).select(
        "id", "pos", "msg.role", "msg.content")


_IM = "'<|im_start|>'"
_IE = "'<|im_end|>'"
_NL = "chr(10)"


def _render_sql(default_system: str | None) -> str:
    body = (f"string_agg({_IM} || role || {_NL} || coalesce(text, '') || {_IE} || {_NL}, '' ORDER BY turn)")
    lead = (f"CASE WHEN arg_min(role, turn) <> 'system' OR arg_min(role, turn) IS NULL THEN "
            f"{_IM} || 'system' || {_NL} || '{default_system}' || {_IE} || {_NL} ELSE '' END || ")
    return f"SELECT conv_id, {lead if default_system else ''}{body} AS text FROM conversations GROUP BY conv_id"


@query("render_chat", sql=_render_sql(H.TEMPLATE_DEFAULT_SYSTEM))
def q_render_chat(spark, d):
    return H.render_turns(X.table(spark, d, "conversations"))


_LEAD = f"{_IM} || 'system' || {_NL} || '{H.TEMPLATE_DEFAULT_SYSTEM}' || {_IE} || {_NL}"
_PLACED_SQL = f"""
t AS (SELECT conv_id, turn, role, text, {_IM} || role || {_NL} || coalesce(text, '') || {_IE} || {_NL} AS piece,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations),
p AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS BIGINT) AS start FROM t)"""


@query("render_chat_chunks", sql=f"""
WITH {_PLACED_SQL}
SELECT conv_id, start // 1024 AS chunk, min(pos) AS first_turn, count(*) AS n_turns, min(start) AS start,
       coalesce(string_agg(CASE WHEN pos = 0 AND coalesce(role, '') <> 'system' THEN {_LEAD} || coalesce(piece, '') ELSE piece END, '' ORDER BY pos), '') AS text
FROM p GROUP BY conv_id, start // 1024""")
def q_render_chat_chunks(spark, d):
    """F3 in chunks of about a thousand characters, cut between turns."""
    return H.render_chunks(X.table(spark, d, "conversations"), chunk_chars=1024)


@query("conversation_message_chunks", sql=f"""
WITH {_PLACED_SQL}
SELECT conv_id, pos // 2 AS chunk, pos % 2 AS place, role, text AS content FROM t""")
def q_message_chunks(spark, d):
    """F11 in chunks of two messages."""
    chunks = H.message_chunks(X.table(spark, d, "conversations"), chunk_turns=2)
    return chunks.select("conv_id", "chunk", F.posexplode("messages").alias("place", "m")).select("conv_id", "chunk", "place", "m.role", "m.content")


@query("role_extract", sql="""
SELECT c.conv_id,
       coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), 'You are a helpful assistant.') AS system,
       coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS "user",
       coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS assistant
FROM conversations c GROUP BY c.conv_id""")
def q_role_extract(spark, d):
    return H.first_contents(X.table(spark, d, "conversations"))


@query("render_prompt", sql=f"""
WITH r AS (
  SELECT conv_id,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), 'You are a helpful assistant.') AS s,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS u
  FROM conversations GROUP BY conv_id)
SELECT conv_id, {_IM} || 'system' || {_NL} || s || {_IE} || {_NL} || {_IM} || 'user' || {_NL} || u || {_IE} || {_NL}
       || {_IM} || 'assistant' || {_NL} AS prompt FROM r""")
def q_render_prompt(spark, d):
    return H.render_prompt_turns(X.table(spark, d, "conversations"))


@query("render_chat_records", sql=_render_sql(H.TEMPLATE_DEFAULT_SYSTEM))
def q_render_chat_records(spark, d):
    """F3 on chat records (``messages`` arrays), as written to chat JSONL."""
    cm = X.conversation_messages(spark, d)
    return cm.select("conv_id", H.render_chat("messages").alias("text"))


_TEMPLATE_SQL = ("'<s>' || 'Instruction: ' || coalesce(instruction, '') || chr(10) || "
                 "CASE WHEN coalesce(input, '') <> '' THEN 'Input: ' || input || chr(10) ELSE '' END || 'Response: '")


@query("prompt_template", ctes=("sft_pairs",), sql=f"""
WITH {_CLEAN_PAIRS}
SELECT id, {_TEMPLATE_SQL} AS prompt, coalesce(output, '') || '</s>' AS response FROM cp""")
def q_prompt_template(spark, d):
    return clean_pairs(spark, d).select("id", H.prompt_template(bos="<s>").alias("prompt"),
                                        H.response_text(eos="</s>").alias("response"))


@query("encode_chars", sql="""
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum,
       CAST(list_max(ids) AS INTEGER) AS max_id
FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ''), lambda ch: unicode(ch)) AS ids
      FROM documents)""")
def q_encode_chars(spark, d):
    docs = X.table(spark, d, "documents")
    ids = H.encode_chars("text")
    return docs.select("doc_id", ids.alias("ids")).select(
        "doc_id", F.size("ids").alias("n_ids"),
        F.aggregate("ids", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("id_sum"),
        F.array_max("ids").alias("max_id"))


@query("sft_tokens", ctes=("sft_pairs",), sql=f"""
WITH {_CLEAN_PAIRS},
e AS (SELECT id, list_transform(string_split({_TEMPLATE_SQL}, ''), lambda ch: unicode(ch)) AS p,
             list_transform(string_split(coalesce(output, '') || '</s>', ''), lambda ch: unicode(ch)) AS r
      FROM cp),
t AS (SELECT id, list_concat(p, r)[1:512] AS ids,
             list_concat(list_transform(p, lambda x: -100), r)[1:512] AS labels FROM e)
SELECT id, array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels,
       CAST(len(ids) AS INTEGER) AS attention_len FROM t""")
def q_sft_tokens(spark, d):
    t = H.sft_tokens(clean_pairs(spark, d), bos="<s>", eos="</s>")
    return t.select("id", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("labels", ",").alias("labels"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attention_len"))


@query("conversation_messages", sql="""
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
       CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id""")
def q_conversation_messages(spark, d):
    cm = X.conversation_messages(spark, d)
    return cm.select("conv_id", F.size("messages").alias("n_messages"),
                     F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                     F.aggregate("messages", F.lit(0).cast("long"),
                                 lambda a, m: a + F.length(F.coalesce(m["content"], F.lit("")))).alias("n_chars"))


def flagship(spark, d):
    """conversations -> instruction pairs -> clean -> exact split -> chat messages."""
    cleaned = clean_pairs(spark, d)
    return H.chat_messages(S.three_way_split(cleaned)).select("id", "split", "messages")


@query("flagship_split_chat", ctes=("sft_pairs",), sql=f"""
WITH {_CLEAN_PAIRS}, {_split3_sql('cp')}
SELECT cp.id, sp.split, 'You are a helpful assistant.' AS system_content,
       CASE WHEN coalesce(input, '') <> '' THEN instruction || chr(10) || chr(10) || 'Context:' || chr(10) || input
            ELSE instruction END AS user_content, output AS assistant_content
FROM cp JOIN sp ON cp.id = sp.id""")
def q_flagship(spark, d):
    f = flagship(spark, d)
    return f.select("id", "split", F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"),
                    F.col("messages")[2]["content"].alias("assistant_content"))
