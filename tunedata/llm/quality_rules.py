"""Quality rules per document, and host verdicts from shrunk failure rates.

Document rules are counted inside the row, without exploding words:
repeated three-word windows are found by sorting one 64-bit number per window
(hash above, position below) and comparing neighbours; as the position takes bits of the hash, the windows
found are sorted and compared again by the whole hash.  What remains is a chance of about
(windows of a text)^2 / 2^65 that two different ones share all 64 bits.

Host rules: the failures of each rule are summed per host (pre-aggregated before
the shuffle), the rates of all hosts fit a beta prior by moments, and each host's
rate is shrunk to it.  A host is rejected when a shrunk rate exceeds ``max_rate``.
Few hosts with many documents and many hosts with few documents are judged by the
same rule; a host with two bad documents is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import WORD, WS, WS_CLASS, let, lines_of, staged, text_of

#: rules summed per host; a rule is a boolean column of ``document_features``
RULES = ("fails_base", "fails_symbols", "fails_word_length", "fails_lines")


def _windows(words: Column) -> Column:
    """One long per three-word window: hash in the high bits, position in the low ones."""
    def pack(s: Column) -> Column:
        h, n = s["h"], F.size(s["h"])
        low = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        return let(F.struct(h.alias("h"), F.expr("1L").alias("one"), low.alias("b")), lambda t: F.transform(
            F.sequence(F.lit(2), F.size(t["h"]) - 1),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(t["h"], i - 2), F.get(t["h"], i - 1), F.get(t["h"], i)), t["b"])
            .bitwiseOR((i - 2).cast("long"))))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(F.struct(hashed.alias("h")), pack)


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more (the first included)."""
    def starts(s: Column) -> Column:
        """Positions of windows whose sorted neighbour is the same window."""
        def same(i: Column, j: Column) -> Column:
            a, b = F.get(s["k"], i), F.get(s["k"], j)
            return F.call_function("shiftright", a, s["b"]) == F.call_function("shiftright", b, s["b"])
        hit = F.filter(s["k"], lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        low = F.expr("1L")
        mask = F.call_function("shiftleft", low, s["b"]) - 1

        def full(x: Column) -> Column:
            p = x.bitwiseAND(mask).cast("int")
            return F.struct(F.xxhash64(*[F.xxhash64(F.get(s["w"], p + j)) for j in range(3)]).alias("h"), p.cast("long").alias("p"))

        def again(t: Column) -> Column:
            """Windows whose whole hash is found twice."""
            return F.filter(t, lambda x, i: F.coalesce((x["h"] == F.get(t, i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(t, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(let(F.sort_array(F.transform(hit, full)), again), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        """Union length of [p, p + 3) over sorted positions."""
        step = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(s: Column) -> Column:
        return let(F.struct(F.sort_array(s["k"]).alias("k"), s["b"].alias("b"), s["w"].alias("w")), lambda t: let(starts(t), covered))

    low = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(F.struct(_windows(words).alias("k"), low.alias("b"), words.alias("w")), count))


def document_features(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50,
                      max_symbol_pct: int = 10, word_chars: tuple[int, int] = (2, 15), max_dup_line_pct: int = 30) -> DataFrame:
    """``docs`` and the counts of one row's whole text; see ``judge_documents``."""
    text = text_of(text_col)
    body = F.trim(text, F.lit(WS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_CLASS + "+", -1))
    full = F.filter(lines_of(text), lambda x: F.trim(x, F.lit(WS)) != "")
    out = docs.withColumns({"__words": words, "__lines": full})
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
    }).drop("__words", "__lines")
    n = F.col("n_words")
    return out.withColumns({
        "fails_base": (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * n),
        "fails_symbols": 100 * F.col("n_symbols") > max_symbol_pct * n,
        "fails_word_length": ~F.col("word_chars").between(word_chars[0] * n, word_chars[1] * n),
        "fails_lines": 100 * F.col("n_dup_lines") > max_dup_line_pct * F.col("n_lines"),
    })


def host_verdicts(features: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Per host: ``host_docs``, the highest shrunk failure rate over the rules and ``host_kept``.

    The prior of a rule is Beta(mean * s, (1 - mean) * s) with the strength ``s`` that the
    spread of the host rates beyond chance implies (method of moments, hosts weighted by
    documents).  Without such spread every host gets the mean.  The null host is a host.
    """
    counts = features.groupBy(F.col(host_col).alias("_host")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    counts = staged(counts, "host-counts")           # one row per host, read three times
    long = counts.select("_host", "_n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("f")) for r in RULES])).alias("x"))
    long = long.select("_host", "_n", "x.rule", "x.f")
    mean = long.groupBy("rule").agg((F.sum("f") / F.sum("_n")).alias("m"), F.sum("_n").alias("total"), F.count(F.lit(1)).alias("hosts"))
    spread = (long.join(F.broadcast(mean), "rule").groupBy("rule", "m", "total", "hosts")
              .agg((F.sum(F.col("_n") * F.pow(F.col("f") / F.col("_n") - F.col("m"), 2)) / F.col("total")).alias("v")))
    noise = F.col("m") * (1 - F.col("m")) * F.col("hosts") / F.col("total")
    between = F.greatest(F.col("v") - noise, F.lit(1e-9))
    prior = spread.select("rule", "m", F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(0.0)).alias("s"))
    rate = (F.col("f") + F.col("m") * F.col("s")) / (F.col("_n") + F.col("s"))
    return (long.join(F.broadcast(prior), "rule").groupBy("_host").agg(F.max("_n").alias("host_docs"), F.max(rate).alias("host_rate"))
            .withColumn("host_kept", F.col("host_rate") <= max_rate))


def judge_documents(features: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``features`` (a stored table: it is read twice) with ``host_docs``, ``host_kept``, ``base_failed``, ``kept``.

    A document fails the base rules with fewer than ``min_words`` words or with more
    than ``max_repeat_pct`` % of its words in repeated three-word windows.  It is kept
    if it passes them and its host is kept.  Null text has no words and fails.
    Repeated rows are judged each, and count each for the host.  Result columns replace
    columns of the same name.  An empty table gives an empty result.

    The verdicts (one row per host) are written first, so that the planner knows their
    size: small tables are broadcast, large ones are joined by a skew-splittable shuffle.
    """
    verdicts = staged(host_verdicts(features, host_col, max_rate), "host-verdicts").withColumnRenamed("_host", "__host")
    out = features.drop("host_docs", "host_rate", "host_kept")
    out = out.join(verdicts, out[host_col].eqNullSafe(verdicts["__host"]), "left").drop("__host", "host_rate")
    return out.withColumns({"base_failed": F.col("fails_base"), "kept": ~F.col("fails_base") & F.col("host_kept")})
