"""Mixing sources to target weights by entropy balancing.

1. Targets: the sources share ``share`` times all words by weight; a source stops at
   ``max_copies`` times its words and the excess goes to the others by weight.  Sources are ranked on the
   cluster (code point order, null last); the level at which the shares fill up is found from sums per place in
   the cycle of weights.
2. Rates: among all document rates that give every source its target words, those closest to
   one copy each (least relative entropy, at most ``max_copies``) are exponentially tilted,
   ``rate = min(max_copies, exp(lambda * size / mean size))``, with one multiplier for each source.
   Newton iterations on the convex dual find the multipliers: every iteration sums the taken
   words and their derivative per source over the (source, size) histogram and writes the table of sources with its next
   multipliers.
3. Copies: a rate's whole part, and one more when the document's hash is below the rest.  What chance
   leaves of each source's target is then made up by moving that threshold, from the
   largest size class to the smallest, by bins of a histogram of hash minus rest.

All sums are integers or decimals, so reruns agree whatever the order of the work.
Any number of sources: they are a stored table with one row each, never gathered on the driver, and the planner broadcasts
it only when its files are small.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import WORD, staged, text_of
from tunedata.plans.ordered import global_rank

BINS = 512


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """Columns of one document: words, source and a uniform hash in [0, 1) of id and text."""
    h = F.xxhash64(F.lit(7), F.col(id_col), text_of(text_col))
    return {"__mix_size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"), "__mix_source": F.col(source_col),
            "__mix_u": F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)}


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, max_copies: int) -> list[float]:
    """Target words of a given list of sources (by code point, null last); ``source_table`` does the same on the cluster."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, active = share * sum(n for _, n in sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while active:
        per = left / sum(weight[i] for i in active)
        over = {i for i in active if per * weight[i] >= max_copies * sizes[i][1]}
        if not over:
            for i in active:
                out[i] = per * weight[i]
            break
        for i in over:
            out[i] = float(max_copies * sizes[i][1])
        left -= sum(out[i] for i in over)
        active -= over
    return out


def _exact_sum(c: Column) -> Column:
    return F.sum(F.round(c, 9).cast("decimal(38,9)"))


def _rate(size: Column, max_copies: int) -> Column:
    tilt = F.exp(F.least(F.col("lam") * size / F.col("mean"), F.lit(math.log(max_copies) + 1.0)))
    return F.when(F.col("full"), F.lit(float(max_copies))).otherwise(F.round(F.least(tilt, F.lit(float(max_copies))), 9))


def source_table(hist: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """Stored table of the sources: ``sid`` (rank), ``source``, ``source_size``, ``target``, ``mean`` size, ``full`` (every
    document at the most copies).

    ``hist``: (__mix_source, __mix_size, n).  The targets are ``min(max_copies * size, level * weight)`` for the level that makes
    them add up.  The level rises from 0: each round fills the sources that it has passed and deals the rest by weight;
    it ends when no source was passed.  This is Newton's method on a concave piecewise linear sum, so the number of rounds grows with
    the logarithm of the spread of sizes, not with the number of sources.
    """
    totals = hist.groupBy("__mix_source").agg(F.sum(F.col("n") * F.col("__mix_size")).alias("w"), F.sum("n").alias("n"))
    ranked = global_rank(totals, [F.col("__mix_source").isNull(), F.col("__mix_source")], "sid")
    place = (F.col("sid") % len(weights)).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
    ranked = staged(ranked.select("sid", F.col("__mix_source").alias("source"), F.col("w").alias("source_size"),
                                  F.greatest(F.col("w") / F.col("n"), F.lit(1e-9)).alias("mean"), place.alias("place"), weight.alias("weight")),
                    "mix-sources")

    def passed(level: float) -> Column:
        return max_copies * F.col("source_size") <= F.lit(level) * F.col("weight")
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        sums = ranked.groupBy("place").agg(F.sum(F.when(passed(level), F.col("source_size")).otherwise(0)).alias("filled"),
                                           F.count_if(~passed(level)).alias("open")).collect()      # one row for each weight
        weight_left = sum(r["open"] * weights[r["place"]] for r in sorted(sums))
        if weight_left == 0:
            level = math.inf
            break
        higher = (share * words - max_copies * sum(r["filled"] for r in sums)) / weight_left
        if higher <= level:
            break
        level = higher
    full = passed(level)
    target = F.when(full, (max_copies * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("sid", "source", "source_size", target.alias("target"), "mean", full.alias("full"))


def solve(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_copies: int = 2,
          tolerance: float = 1e-7, max_iterations: int = 60) -> DataFrame:
    """``source_table`` with the multiplier ``lam`` of every source, stored.

    ``sizes``: stored table of the columns of ``sized``.  A step that leaves the bracket of known multipliers is replaced by its
    middle.  A warning says how many sources are beyond the tolerance after the last iteration (their rest is left to the thresholds).
    """
    hist = staged(sizes.groupBy("__mix_source", "__mix_size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    unknown = F.lit(None).cast("double")
    now = source_table(hist, weights, share, max_copies).withColumns({"lam": F.lit(0.0), "low": unknown, "high": unknown})
    keys, size = now.columns, F.col("__mix_size")
    for _ in range(max_iterations):
        rate = _rate(size, max_copies)
        taken = F.col("n") * size * rate
        slope = F.when(rate < max_copies, taken * size / F.col("mean")).otherwise(F.lit(0.0))
        sums = (hist.join(now, F.col("__mix_source").eqNullSafe(F.col("source"))).groupBy(*keys)
                .agg(_exact_sum(taken).cast("double").alias("__taken"), _exact_sum(slope).cast("double").alias("__slope")))
        gap = F.col("target") - F.col("__taken")
        sums = sums.withColumns({"__gap": gap, "__open": ~F.col("full") & (F.abs(gap) > tolerance * F.greatest("target", F.lit(1.0)))})
        sums = sums.withColumns({"low": F.when(F.col("__open") & (F.col("__gap") > 0), F.col("lam")).otherwise(F.col("low")),
                                 "high": F.when(F.col("__open") & (F.col("__gap") <= 0), F.col("lam")).otherwise(F.col("high"))})
        step = F.when(F.col("__slope") > 0, F.col("lam") + F.col("__gap") / F.col("__slope")).otherwise(F.signum("__gap") * F.lit(math.inf))
        # a null end of the bracket makes the test null: the step is taken
        step = F.when(~((F.col("low") < step) & (step < F.col("high"))) & F.col("low").isNotNull() & F.col("high").isNotNull(),
                      (F.col("low") + F.col("high")) / 2).otherwise(step)
        reach = 4.0 + F.abs("lam")
        lam = F.when(F.col("__open"), F.least(F.greatest(step, F.col("lam") - reach), F.col("lam") + reach)).otherwise(F.col("lam"))
        got = staged(sums.withColumn("lam", lam).select(*keys, "__open"), "mix-step")
        now = got.drop("__open")
        left = got.where("__open").count()
        if not left:
            break
    else:
        warnings.warn(f"{left} sources are not at their target after {max_iterations} Newton steps", stacklevel=2)
    return now.drop("low", "high")


def _joined(df: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """Columns of ``sized`` with the source's columns (prefixed), the rate, its whole part and hash minus rest."""
    named = sources.withColumnsRenamed({c: f"__mix_{c}" for c in ("source_size", "target", "sid", "threshold") if c in sources.columns})
    out = df.join(named, F.col("__mix_source").eqNullSafe(F.col("source")), "left")
    out = out.withColumn("__mix_rate", _rate(F.col("__mix_size"), max_copies)).drop("source", "mean", "lam", "full")
    return out.withColumns({"__mix_whole": F.floor("__mix_rate"), "__mix_margin": F.col("__mix_u") - (F.col("__mix_rate") - F.floor("__mix_rate")),
                            "__mix_class": F.when(F.col("__mix_size") > 0, F.floor(F.log2(F.col("__mix_size").cast("double")))).otherwise(-1).cast("int")})


def _shift(moves: list, gap: float) -> dict:
    """Thresholds of one source by size class: ``moves`` are its (class, bin, words of the bin), ``gap`` the words still to take."""
    out, by_class = {}, {}
    for k, b, words in moves:
        by_class.setdefault(k, []).append((b, words))
    for k in sorted(by_class, reverse=True):
        edge, up = BINS, gap > 0
        for b, words in sorted(x for x in by_class[k] if x[0] >= BINS) if up else sorted((x for x in by_class[k] if x[0] < BINS), reverse=True):
            if words > 2 * abs(gap):          # taking it would leave more than it makes up
                break
            gap += -float(words) if up else float(words)
            edge = b + 1 if up else b
            if (gap > 0) != up:
                break
        out[k] = (edge - BINS) / BINS
    return out


def thresholds(sizes: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """``sources`` and ``threshold``, a map from size class (at most 64) to the margin below which a document gets one more copy."""
    j = _joined(sizes, sources, max_copies)
    natural = F.col("__mix_size") * (F.col("__mix_whole") + (F.col("__mix_margin") < 0).cast("int"))
    bins = staged(j.groupBy(F.col("__mix_sid").alias("sid"), F.col("__mix_class").alias("k"), F.floor(F.col("__mix_margin") * BINS + BINS).cast("int").alias("bin"),
                            (F.col("__mix_rate") < max_copies).alias("open")).agg(F.sum("__mix_size").alias("words"), F.sum(natural).alias("taken")), "mix-bins")
    gaps = bins.groupBy("sid").agg(F.sum("taken").alias("taken")).join(sources.select("sid", "target"), "sid")
    gaps = gaps.select("sid", (F.col("target") - F.col("taken")).alias("gap"))
    moves = bins.where("open and k >= 0").groupBy("sid").agg(F.collect_list(F.struct("k", "bin", "words")).alias("moves"))   # at most 64 x 2 x BINS
    cut = moves.join(gaps, "sid").select("sid", F.udf(_shift, "map<int,double>", useArrow=False)("moves", "gap").alias("threshold"))
    return staged(sources.join(cut, "sid", "left"), "mix-thresholds")


def mix_sources(docs: DataFrame, sizes: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=(5.0, 2.0, 1.0), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """``docs`` and ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken`` (copies times size).

    Sources in code point order, null last (the null source is a source), weigh ``weights`` in turn.  A null or
    empty text has size 0 and takes nothing.  Rows equal in id and text have the same hash and move
    together; a source of nothing else than such rows can miss its target.  Result columns
    replace columns of the same name.  An empty table gives an empty result.

    ``docs`` may be the stored table of ``sized`` itself (then the text is read once).
    """
    cols = sized(docs, id_col, text_col, source_col)
    if sizes is None:
        sizes = staged(docs.select(*[c.alias(n) for n, c in cols.items()]), "mix-sizes")
        docs = docs.withColumns(cols)
    sources = thresholds(sizes, solve(sizes, weights, share, max_copies), max_copies)
    keep = [c for c in docs.columns if not c.startswith("__mix_") and c not in ("size", "source_size", "target", "rate", "copies", "taken")]
    renamed = {c: f"__in_{c}" for c in keep}
    out = _joined(docs.withColumnsRenamed(renamed), sources, max_copies)
    cut = F.coalesce(F.element_at("__mix_threshold", F.col("__mix_class")), F.lit(0.0))
    copies = (F.col("__mix_whole") + ((F.col("__mix_margin") < cut) & (F.col("__mix_rate") < max_copies)).cast("int")).cast("int")
    return out.select(*[F.col(f"__in_{c}").alias(c) for c in keep], F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
                      F.col("__mix_target").alias("target"), F.col("__mix_rate").alias("rate"), copies.alias("copies"),
                      (copies * F.col("__mix_size")).alias("taken"))
