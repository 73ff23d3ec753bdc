"""Formatting for training (F1-F11): chat messages, ChatML text, prompt template, token ids.

All of it is native array/string expressions, so it stays inside whole-stage
codegen; only a pluggable tokenizer (``encode_with``) needs Python, and it
runs as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.plans.ordered import sums_by_rows

# Default prompts and the ChatML markers of the Qwen2.5 chat template.
DEFAULT_SYSTEM_PROMPT = "You are a helpful assistant."
TEMPLATE_DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
CONTEXT_SEPARATOR = "\n\nContext:\n"
LABEL_MASK = -100
MAX_LENGTH = 512


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def user_message(instruction="instruction", inp="input") -> Column:
    """instruction, plus the context block when input is non-empty."""
    i = F.coalesce(_c(inp), F.lit(""))
    return F.when(i != "", F.concat(_c(instruction), F.lit(CONTEXT_SEPARATOR), i)).otherwise(_c(instruction))


def message(role: str | Column, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _c(content).alias("content"))


def chat_messages(df: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """``messages`` = [system, user, assistant]."""
    msgs = F.array(message("system", F.lit(system_prompt)), message("user", user_message()),
                   message("assistant", F.col("output")))
    return df.withColumn("messages", msgs)


def _render_turns(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(IM_END + "\n"))), "")


def render_chat(messages="messages", default_system: str | None = TEMPLATE_DEFAULT_SYSTEM,
                add_generation_prompt: bool = False) -> Column:
    """ChatML text of a conversation (the template adds a system turn if none leads)."""
    m = _c(messages)
    text = _render_turns(m)
    if default_system is not None:
        lead = F.concat(F.lit(f"{IM_START}system\n{default_system}{IM_END}\n"), text)
        text = F.when(F.coalesce(F.get(m, 0)["role"], F.lit("")) != "system", lead).otherwise(text)
    if add_generation_prompt:
        text = F.concat(text, F.lit(f"{IM_START}assistant\n"))
    return text


def first_content(messages, role: str, default: str = "") -> Column:
    """content of the first turn with ``role``, else ``default``."""
    hit = F.filter(_c(messages), lambda m: m["role"] == role)
    return F.coalesce(F.get(hit, 0)["content"], F.lit(default))


def render_prompt(messages="messages", default_system: str = DEFAULT_SYSTEM_PROMPT) -> Column:
    """system + first user turn, with the generation suffix (evaluation prompt)."""
    m = _c(messages)
    prompt_msgs = F.array(message("system", first_content(m, "system", default_system)),
                          message("user", first_content(m, "user", "")))
    return render_chat(prompt_msgs, default_system=None, add_generation_prompt=True)


def prompt_template(instruction="instruction", inp="input", bos: str = "") -> Column:
    """``{bos}Instruction: ...\\n[Input: ...\\n]Response: ``."""
    i = F.coalesce(_c(inp), F.lit(""))
    body = F.concat(F.lit("Instruction: "), F.coalesce(_c(instruction), F.lit("")), F.lit("\n"),
                    F.when(i != "", F.concat(F.lit("Input: "), i, F.lit("\n"))).otherwise(F.lit("")),
                    F.lit("Response: "))
    return F.concat(F.lit(bos), body)


def response_text(output="output", eos: str = "") -> Column:
    return F.concat(F.coalesce(_c(output), F.lit("")), F.lit(eos))


def encode_chars(text) -> Column:
    """F8 built-in fallback encoder: one id per character = its code point."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(t == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(t, ""), lambda ch: F.ascii(ch)))


def encode_with(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """F8 pluggable encoder (e.g. a tokenizer's ``encode``) as an Arrow pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _enc(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: list(encode(x)))

    return lambda col: _enc(_c(col))


def sft_tokens(df: DataFrame, bos: str = "", eos: str = "", max_length: int = MAX_LENGTH,
               encoder: Callable[[Column], Column] = encode_chars) -> DataFrame:
    """input_ids, attention_mask, labels (prompt masked with -100), truncated."""
    p = encoder(prompt_template(bos=bos))
    r = encoder(response_text(eos=eos))
    ids = F.concat(p, r)
    labels = F.concat(F.array_repeat(F.lit(LABEL_MASK), F.size(p)), r)
    cut_ids = F.slice(ids, 1, max_length)
    return (df.withColumn("input_ids", cut_ids)
              .withColumn("labels", F.slice(labels, 1, max_length))
              .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(cut_ids))))


# ---------------------------------------------------- turn-per-row conversations
# The same formatting for tables that keep one row per turn.  ``min_by`` is partially aggregated before the
# shuffle; ``listagg`` gathers a conversation's text in one buffer.  ``render_chunks`` and ``message_chunks`` are the
# forms for conversations of any length.
def _turn_text(role_col: str, text_col: str) -> Column:
    return F.concat(F.lit(IM_START), F.col(role_col), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")), F.lit(IM_END + "\n"))


def render_turns(turns: DataFrame, key: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", default_system: str | None = TEMPLATE_DEFAULT_SYSTEM) -> DataFrame:
    """F3 over turn rows: ChatML text per conversation."""
    piece = _turn_text(role_col, text_col).alias("_piece")
    body = F.expr(f"listagg(_piece, '') WITHIN GROUP (ORDER BY {order_col})")
    agg = (turns.select(key, order_col, role_col, piece).groupBy(key)
           .agg(body.alias("_body"), F.min_by(role_col, order_col).alias("_first_role")))
    text = F.col("_body")
    if default_system is not None:
        lead = F.lit(f"{IM_START}system\n{default_system}{IM_END}\n")
        text = F.when(F.coalesce(F.col("_first_role"), F.lit("")) != "system", F.concat(lead, text)).otherwise(text)
    return agg.select(key, text.alias("text"))


def render_chunks(turns: DataFrame, key: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  default_system: str | None = TEMPLATE_DEFAULT_SYSTEM, chunk_chars: int = 1 << 20) -> DataFrame:
    """F3 for conversations of any length: rows (key, ``chunk``, ``first_turn``, ``n_turns``, ``start``, ``text``); the texts of a
    conversation's chunks, in order of ``chunk``, are its ChatML text.

    ``first_turn`` is the position of the chunk's first turn, ``start`` the number of characters of the turns before it (an added
    system turn, which leads the first chunk, is not counted).  Turns are never cut: a turn belongs to chunk
    ``floor(start of the turn / chunk_chars)``, so a chunk is shorter than ``chunk_chars`` and one turn, and numbers that a long turn
    runs over are missing.  No task and no buffer holds more of a conversation than a chunk.  Turns of equal number stay in stored order, null
    numbers come first, null keys are one conversation; a turn with a null role has no text.
    """
    piece = turns.select(F.col(key).alias("_key"), F.col(order_col).alias("_order"), F.col(role_col).alias("_role"),
                         _turn_text(role_col, text_col).alias("_piece"))
    placed = sums_by_rows(piece, ["_key"], ["_order"], {"_pos": F.lit(1), "_start": F.length("_piece")})
    if default_system is not None:
        lead = F.lit(f"{IM_START}system\n{default_system}{IM_END}\n")
        missing = (F.col("_pos") == 0) & (F.coalesce(F.col("_role"), F.lit("")) != "system")
        placed = placed.withColumn("_piece", F.when(missing, F.concat(lead, F.coalesce("_piece", F.lit("")))).otherwise(F.col("_piece")))
    return (placed.groupBy(F.col("_key").alias(key), F.floor(F.col("_start") / chunk_chars).alias("chunk"))
            .agg(F.min("_pos").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"), F.min("_start").alias("start"),
                 F.coalesce(F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY _pos)"), F.lit("")).alias("text")))


def message_chunks(turns: DataFrame, key: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   chunk_turns: int = 1024) -> DataFrame:
    """F11 for conversations of any length: rows (key, ``chunk``, ``messages``) of ``chunk_turns`` turns each (the last one of fewer),
    numbered from 0; order as in ``render_chunks``."""
    named = turns.select(F.col(key).alias("_key"), F.col(order_col).alias("_order"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    placed = sums_by_rows(named, ["_key"], ["_order"], {"_pos": F.lit(1)})
    messages = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "role", "content"))), lambda m: message(m["role"], m["content"]))
    return placed.groupBy(F.col("_key").alias(key), F.floor(F.col("_pos") / chunk_turns).alias("chunk")).agg(messages.alias("messages"))


def joined_chunks(chunks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Whole texts of the conversations in ``chunks`` (from ``render_chunks``; filter it to those asked for first)."""
    return chunks.groupBy(key).agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY chunk)").alias("text"))


def first_contents(turns: DataFrame, key: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", defaults: dict[str, str] | None = None) -> DataFrame:
    """F5 over turn rows: the first content of each role, with defaults."""
    defaults = defaults if defaults is not None else {"system": DEFAULT_SYSTEM_PROMPT, "user": "", "assistant": ""}
    aggs = [F.coalesce(F.min_by(F.when(F.col(role_col) == r, F.col(text_col)),
                                F.when(F.col(role_col) == r, F.col(order_col))), F.lit(d)).alias(r)
            for r, d in defaults.items()]
    return turns.groupBy(key).agg(*aggs)


def render_prompt_turns(turns: DataFrame, key: str = "conv_id", **kw) -> DataFrame:
    """F4 over turn rows: system + first user turn + generation suffix."""
    fc = first_contents(turns, key, **kw)
    prompt = F.concat(F.lit(f"{IM_START}system\n"), F.col("system"), F.lit(f"{IM_END}\n{IM_START}user\n"),
                      F.col("user"), F.lit(f"{IM_END}\n{IM_START}assistant\n"))
    return fc.select(key, prompt.alias("prompt"))
