"""Conversations in chunks: the chunks' texts add up to the rendered conversation, whatever its length and its broken rows."""

from pyspark.sql import functions as F

from tunedata.operators import chat as H

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows, lead=H.TEMPLATE_DEFAULT_SYSTEM):
    """Text by conversation, turns in order (null numbers first)."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"<|im_start|>{role}\n{t or ''}<|im_end|>\n" for _, _, role, t in own if role is not None)
        out[key] = ("" if own[0][2] == "system" else f"<|im_start|>system\n{lead}<|im_end|>\n") + text
    return out


def texts(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk):
        out[r.conv_id] = out.get(r.conv_id, "") + r.text
    return out


def test_chunks_add_up(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], "x" * ((t * 37 + c) % 90)) for c in range(5) for t in range(c * 9 + 1)]
    rows += [(7, 0, "system", "be short"), (7, 1, "user", None), (7, 3, None, "lost"), (8, None, "user", "no number"), (8, 0, "assistant", "näïve 😀"),
             (None, 0, "user", "no key"), (None, 1, "assistant", "none"), (9, 0, None, "no role"), (9, 1, "user", "y" * 5000), (9, 2, "user", "z")]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("chunk", F.lit("clash"))
    for size in (1, 100, 1 << 20):
        chunks = H.render_chunks(turns, chunk_chars=size)
        assert texts(chunks) == brute(rows)
        assert {r.conv_id: r.text for r in H.joined_chunks(chunks).collect()} == brute(rows)
    got = H.render_chunks(turns, chunk_chars=100).collect()
    assert sum(r.n_turns for r in got) == len(rows) and max(len(r.text) for r in got if r.conv_id is not None and r.conv_id < 5) < 100 + 120 + 120
    assert {(r.chunk, r.first_turn, r.n_turns) for r in got if r.conv_id == 9} == {(0, 0, 2), (50, 2, 1)}
    empty = spark.createDataFrame([], SCHEMA)
    assert H.render_chunks(empty).count() == 0 and H.message_chunks(empty).count() == 0


def test_no_buffer_of_a_long_conversation(spark):
    """One conversation of 200,000 turns: bounded chunks that equal the whole, messages in blocks of equal length."""
    n = 200_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    chunks = H.render_chunks(turns.orderBy(F.rand(1)), chunk_chars=1 << 16, default_system=None).collect()
    assert max(len(r.text) for r in chunks) < (1 << 16) + 100 and len(chunks) > 50
    whole = "".join(f"<|im_start|>{['user', 'assistant'][i % 2]}\n{i}<|im_end|>\n" for i in range(n))
    assert "".join(r.text for r in sorted(chunks, key=lambda r: r.chunk)) == whole
    sizes = H.message_chunks(turns, chunk_turns=1024).select("chunk", F.size("messages").alias("n"), F.col("messages")[0]["content"].alias("first")).collect()
    assert sorted((r.chunk, r.n, r.first) for r in sizes) == [(k, min(1024, n - k * 1024), str(k * 1024)) for k in range(-(-n // 1024))]
