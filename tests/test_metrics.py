"""Metrics: the reference's literal cases, brute-force checks of LCS and overlaps, F-score bounds."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tunedata.functions.pairstats import _lcs_udf, bigrams, lcs_length, overlap, replaced
from tunedata.operators import metrics as M

PAIR = "id long, model_id string, reference string, prediction string"


def _dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=70))
def test_lcs_equals_dp(a, b):
    assert lcs_length(a, b) == _dp_lcs(a, b) == lcs_length(b, a) <= min(len(a), len(b))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=70), st.integers(1, 40))
def test_lcs_in_blocks_equals_dp(a, b, block):
    assert lcs_length(a, b, block) == _dp_lcs(a, b)


def _traced_peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lcs_of_long_texts_needs_memory_in_proportion():
    peak = [_traced_peak(lambda: lcs_length([str(i) for i in range(n)], ["0", str(n - 1)]))[1] for n in (20000, 40000)]
    assert peak[1] < 2.5 * peak[0]                   # one bit vector for each word of the whole text: four times as much


def test_lcs_batch_is_not_held_as_python_objects(spark):
    words = [str(i) for i in range(1000)]
    a, udf = pa.array([words] * 2000), _lcs_udf()
    got, peak = _traced_peak(lambda: udf.func(a, a))
    assert got.to_pylist() == [1000] * 2000 and peak < 40e6         # 4 million tokens are over 200 MB of strings


def _scores(spark, pred, ref):
    df = spark.createDataFrame([(1, "m", ref, pred)], PAIR)
    return M.pair_scores(df, ["id", "model_id"]).first()


def test_reference_bleu_cases(spark):
    assert _scores(spark, "the cat sat on the mat", "the cat sat on the mat").bleu1 == 1.0
    assert _scores(spark, "sat cat", "the cat sat").bleu1 == 1.0


def test_reference_rouge_l_cases(spark):
    assert _scores(spark, "the cat sat", "the cat sat").rouge_l == 1.0
    assert round(_scores(spark, "the sat", "the cat sat").rouge_l, 2) == 0.80


def test_empty_sides_score_zero(spark):
    s = _scores(spark, "", "the cat")
    assert (s.bleu1, s.rouge_l, s.rouge1, s.rouge2, s.rougeL) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_classification_reference_case(spark):
    rows = [(0, "m", "positive", "positive"), (1, "m", "positive", "negative"), (2, "m", "negative", "positive")]
    df = spark.createDataFrame(rows, PAIR)
    r = M.macro_scores(df, ["model_id"]).first()
    assert round(r.accuracy, 2) == 0.33 and r.precision == 0.25 and r.recall == 0.25 and r.f1_score == 0.25


def _py_rouge_n(p, r, n):
    gp = list(zip(*[p[i:] for i in range(n)])) if len(p) >= n else []
    gr = list(zip(*[r[i:] for i in range(n)])) if len(r) >= n else []
    ov = sum((Counter(gp) & Counter(gr)).values())
    pr, rc = ov / max(len(gp), 1), ov / max(len(gr), 1)
    return 2 * pr * rc / (pr + rc) if pr + rc > 0 else 0.0


def test_pair_scores_equal_plain_python(spark):
    rnd = random.Random(3)
    words = ["the", "cat", "sat", "on", "mat", "A", "dog", "x-y", "Ünïcode", "é"]
    rows = []
    for i in range(60):
        ref = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))
        pred = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))
        rows.append((i, "m", ref, pred))
    got = {r.id: r for r in M.pair_scores(spark.createDataFrame(rows, PAIR), ["id", "model_id"]).collect()}
    import re
    for i, _, ref, pred in rows:
        p, r = pred.strip().lower().split(), ref.strip().lower().split()
        bleu = 0.0 if not p or not r else sum((Counter(p) & Counter(r)).values()) / len(p)
        l = _dp_lcs(p, r)
        rl = 0.0 if not p or not r else (2 * (l / len(r)) * (l / len(p))) / ((l / len(r)) + (l / len(p))) if l else 0.0
        rp = [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", pred.lower())) if t]
        rr = [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", ref.lower())) if t]
        common = set(r) & set(p)
        pw, rw = len(common) / max(1, len(pred.split())), len(common) / max(1, len(ref.split()))
        wf = (2 * pw * rw) / (pw + rw) if pw + rw > 0 else 0.0
        g = got[i]
        assert abs(g.bleu1 - bleu) < 1e-12 and abs(g.rouge_l - rl) < 1e-12
        assert abs(g.rouge1 - _py_rouge_n(rp, rr, 1)) < 1e-12 and abs(g.rouge2 - _py_rouge_n(rp, rr, 2)) < 1e-12
        assert abs(g.word_f1 - wf) < 1e-12
        assert g.exact_match == (1.0 if pred.lower().strip() == ref.lower().strip() else 0.0)
        assert all(0.0 <= v <= 1.0 for v in (g.bleu1, g.rouge_l, g.rouge1, g.rouge2, g.rougeL, g.word_f1))


def test_overlaps_equal_counters(spark):
    rnd = random.Random(9)
    sides = [[rnd.choice(["a", "b", "B", "é", "a1", "1"]) for _ in range(rnd.choice([0, 1, 2, 5, 40]))] for _ in range(400)]
    rows = list(zip(range(200), sides[:200], sides[200:])) + [(200, ["x"] * 20000, ["y", "x"] * 15000)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = {r.id: (r.o, r.o2) for r in df.select("id", overlap(F.col("a"), F.col("b")).alias("o"),
                                                overlap(bigrams(F.col("a")), bigrams(F.col("b"))).alias("o2")).collect()}
    for i, a, b in rows:
        pairs = [Counter(zip(x, x[1:])) for x in (a, b)]
        assert got[i] == (sum((Counter(a) & Counter(b)).values()), sum((pairs[0] & pairs[1]).values()))


def test_stemmed_rouge_with_a_stems_table(spark):
    df = spark.createDataFrame([(1, "m", "the cats were running", "a cat was runs")], PAIR)
    stems = spark.createDataFrame([("cats", "cat"), ("running", "run"), ("runs", "run"), ("were", "were")],
                                  "token string, stem string")
    plain = M.pair_scores(df, ["id", "model_id"], ["rouge1"]).first().rouge1
    stemmed = M.pair_scores(df, ["id", "model_id"], ["rouge1"], stems=stems).first().rouge1
    # tokens of length <= 3 are never stemmed ("cat", "was", "a"); "cats"->"cat", "running"/"runs"->"run"
    ref, pred = ["the", "cat", "were", "run"], ["a", "cat", "was", "run"]
    assert plain == 0.0 and abs(stemmed - _py_rouge_n(pred, ref, 1)) < 1e-12 and stemmed == 0.5


def test_replaced_tokens_equal_a_dict(spark):
    rnd = random.Random(5)
    words = ["a", "ab", "é", "zz", "b", "Ab"]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 30]))],
             {w: rnd.choice(["x", "a", ""]) for w in rnd.sample(words, rnd.randint(0, 6))}) for i in range(200)]
    rows.append((200, [f"w{i % 30000}" for i in range(60000)], {f"w{i}": f"s{i}" for i in range(30000)}))  # a map would be searched 30,000 x 60,000 times
    df = spark.createDataFrame([(i, t, [(k, -1, v) for k, v in d.items()]) for i, t, d in rows],
                               "id int, t array<string>, e array<struct<t:string,i:int,s:string>>")
    got = {r.id: r.o for r in df.select("id", replaced(F.col("t"), F.col("e")).alias("o")).collect()}
    assert all(got[i] == [d.get(x, x) for x in t] for i, t, d in rows)


def _exchanged(df):
    """Columns of each exchange by keys in the plan, with their types."""
    plan = df._jdf.queryExecution().executedPlan()
    found, nodes = [], [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            found.append([(node.output().apply(i).name(), node.output().apply(i).dataType().simpleString()) for i in range(node.output().size())])
    return found


def test_stemming_moves_texts_and_changed_words_only(spark):
    rows = [(i, "m", "walking dogs barked at cats " * 3, "dogs walked and barking cat") for i in range(50)]
    df = spark.createDataFrame(rows, PAIR)
    table = [("walking", "walk"), ("walked", "walk"), ("dogs", "dog"), ("barked", "bark"), ("barking", "bark"), ("cats", "cat"), ("and", "no")]
    scored = M.pair_scores(df, ["id", "model_id"], ["rouge1", "rouge2"], stems=spark.createDataFrame(table, "token string, stem string"))
    moved = _exchanged(scored)
    assert moved and not [c for cols in moved for c in cols if c[1] == "array<string>" or c[0] == "_pos"]
    ref, pred = ["walk", "dog", "bark", "at", "cat"] * 3, ["dog", "walk", "and", "bark", "cat"]
    want = tuple(_py_rouge_n(pred, ref, n) for n in (1, 2))
    assert {(round(r.rouge1 - want[0], 12), round(r.rouge2 - want[1], 12)) for r in scored.collect()} == {(0.0, 0.0)}


def test_rows_that_share_keys_share_stemmed_tokens(spark):
    df = spark.createDataFrame([(1, "m", "cats sing", "cats"), (1, "m", "dogs", "dogs walk"), (2, "m", "cats", "cat")], PAIR)
    stems = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, stem string")
    got = sorted((r.id, r.rouge1, r.rouge2) for r in M.pair_scores(df, ["id", "model_id"], ["rouge1", "rouge2"], stems=stems).collect())
    one = tuple(_py_rouge_n(["cat", "dog", "walk"], ["cat", "dog", "sing"], n) for n in (1, 2))
    assert got == [(1, *one), (1, *one), (2, 1.0, 0.0)]
