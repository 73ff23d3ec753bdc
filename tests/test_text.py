"""Text helpers must match Python's str semantics (strip / split / len / ord)."""

from pyspark.sql import functions as F

from tunedata.functions.text import (WS_CHARS, estimate_tokens, is_missing, lower_tokens, rouge_tokens, tokens,
                                     ustrip)
from tunedata.operators.chat import encode_chars

SAMPLES = ["　 A b C\x1cd\x85e ", "", "  ", "aé\U0001F600b", "x y z\tw\n", None,
           "The cat.  sat, on-the MAT!", "​ zero-width is not space"]


def _py_est(t):
    if not t:
        return 0
    w = t.split()
    return max(1, int(len(w) * 1.3)) if w else 0


def test_whitespace_set_is_python_isspace():
    assert all((chr(c) in WS_CHARS) == chr(c).isspace() for c in range(0x110000))


def test_strip_tokens_estimate_match_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    rows = df.select("i", ustrip("s").alias("st"), tokens("s").alias("tk"), estimate_tokens("s").alias("est"),
                     is_missing("s").alias("miss"), F.length("s").alias("n")).orderBy("i").collect()
    for r in rows:
        s = SAMPLES[r.i]
        if s is None:
            assert r.miss and r.tk == [] and r.est == 0
            continue
        assert r.st == s.strip()
        assert r.tk == s.split()
        assert r.est == _py_est(s)
        assert r.miss == (s.strip() == "")
        assert r.n == len(s)


def test_token_estimate_integer_rule_matches_float_rule():
    assert all((n * 13) // 10 == int(n * 1.3) for n in range(1, 20001))


def test_lower_and_rouge_tokens(spark):
    df = spark.createDataFrame([("The cat.  sat, on-the MAT!",)], "s string")
    r = df.select(lower_tokens("s").alias("a"), rouge_tokens("s").alias("b")).first()
    assert r.a == "The cat.  sat, on-the MAT!".lower().split()
    assert r.b == ["the", "cat", "sat", "on", "the", "mat"]


def test_code_points(spark):
    df = spark.createDataFrame([("aé\U0001F600b",), ("",)], "s string")
    got = [r.ids for r in df.select(encode_chars("s").alias("ids")).collect()]
    assert got == [[97, 233, 128512, 98], []]


def test_rounding_is_that_of_python(spark):
    """Values with two decimals over 1000, random doubles, and exact ties, in both engines."""
    import random

    import duckdb

    from tunedata.functions.text import round2, round4
    from tunedata.plans.sqlfrag import rnd
    rng = random.Random(5)
    xs = [i / 100 / 1000 for i in range(50001)] + [rng.uniform(-3, 3) * 10 ** rng.randint(-4, 5) for _ in range(20000)]
    xs += [i / 32 for i in range(-64, 64)] + [0.125, 0.375, 2.675, 1.005, -0.00005, 1e15 / 7]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for r in df.select("x", round4("x").alias("a"), round2("x").alias("b")).collect():
        assert r.a == round(r.x, 4) and r.b == round(r.x, 2), r
    con = duckdb.connect()
    values = ", ".join(f"({x!r}::DOUBLE)" for x in xs[:5000] + xs[-2000:])
    for x, a, b in con.execute(f"SELECT x, {rnd('x', 4)}, {rnd('x', 2)} FROM (VALUES {values}) t(x)").fetchall():
        assert a == round(x, 4) and b == round(x, 2), x
