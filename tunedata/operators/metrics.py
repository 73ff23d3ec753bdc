"""Evaluation metrics (E1-E14) as per-pair tables plus aggregates.

Per-pair scores are row expressions: multiset overlaps (BLEU-1, ROUGE-1/2) number
the equal tokens of a sorted array and intersect, so the per-pair table needs no
shuffle at all and is as parallel as the input.  LCS (ROUGE-L) is the only
Python step (Arrow UDF over token arrays).  Means are ordinary aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.functions.pairstats import bigrams, in_position_order, lcs, overlap, replaced
from tunedata.functions.text import lower_tokens, round2, round4, rouge_tokens, ustrip

GENERATION, CLASSIFICATION = "generation", "classification"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ------------------------------------------------------------------ pairing
def pair_predictions(samples: DataFrame, preds: DataFrame, keys: list[str],
                     ref_col: str = "reference", pred_col: str = "prediction") -> DataFrame:
    """Every sample with its prediction(s); a missing side becomes ''."""
    j = samples.join(preds, keys, "left")
    return (j.withColumn(ref_col, F.coalesce(F.col(ref_col), F.lit("")))
             .withColumn(pred_col, F.coalesce(F.col(pred_col), F.lit(""))))


# ------------------------------------------------------------- per-pair scores
PAIR_METRICS = ("bleu1", "rouge_l", "rouge1", "rouge2", "rougeL", "exact_match", "word_f1")


def _f(p: Column, r: Column) -> Column:
    # rouge-score order: 2 * precision * recall / (precision + recall)
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _lcs_score(l: Column, n_pred: Column, n_ref: Column, reference_order: bool) -> Column:
    l = l.cast("double")
    r, p = l / n_ref, l / n_pred
    if reference_order:   # (2 * recall * precision) / (recall + precision)
        f = F.when(r + p > 0, (F.lit(2.0) * r * p) / (r + p)).otherwise(F.lit(0.0))
    else:
        f = _f(p, r)
    return F.when((n_pred == 0) | (n_ref == 0), F.lit(0.0)).otherwise(f)


#: characters of text whose words one task of ``stem_tokens`` regroups
TASK_CHARS = 8_000_000


def stem_tokens(df: DataFrame, keys: list[str], texts: dict[str, str], stems: DataFrame, min_len: int = 4) -> DataFrame:
    """``df`` with columns of rouge-score tokens (``texts``: name -> text column), each token replaced by its stem from a
    ``stems(token, stem)`` table.

    The rouge-score package stems tokens longer than three characters with a
    Porter stemmer; here the stemmer is a table (any stemmer's output, computed
    once per vocabulary).  The different long tokens of a row are exploded and joined to
    the table on the token (AQE splits a very frequent token's partition); only those with another stem are regrouped
    and joined back on the keys.  The arrays are made after that join, so that it sorts texts and short lists of words, not arrays,
    and the number of its tasks follows the texts (their length is summed while the plan is built).
    Rows that share their keys share their tokens, in position order.
    """
    tokens = {c: rouge_tokens(t) for c, t in texts.items()}
    chars = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts.values()), F.lit(0))
    total = df.agg(F.sum(chars.cast("long"))).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_CHARS))
    rows = df.withColumn("_key", F.struct(*keys))                   # never null, so that null keys match too
    table = stems.select(F.col("token").alias("_tok"), F.col("stem").alias("_stem"))
    words = F.array_distinct(F.filter(F.concat(*tokens.values()), lambda t: F.length(t) >= min_len))
    entry = F.struct(F.col("_tok").alias("t"), F.lit(-1).alias("i"), F.col("_stem").alias("s"))
    # a left join: of an inner one Spark may broadcast the words, whose number it does not know
    changed = rows.select("_key", F.explode(words).alias("_tok")).join(table, "_tok", "left").where(F.coalesce("_stem", "_tok") != F.col("_tok"))
    found = changed.select("_key", entry.alias("_entry")).repartition(n, "_key").groupBy("_key").agg(F.collect_set("_entry").alias("_stems"))
    joined = rows.repartition(n, "_key").join(found, "_key", "left")
    none = F.array().cast("array<struct<t:string,i:int,s:string>>")
    stemmed = joined.withColumns({c: replaced(t, F.coalesce("_stems", none)) for c, t in tokens.items()})
    shared = Window.partitionBy("_key")
    lists = stemmed.withColumns({f"_l_{c}": F.collect_list(c).over(shared) for c in tokens})
    return lists.select(*df.columns, *[F.when(F.size(f"_l_{c}") > 1, in_position_order(F.col(f"_l_{c}"))).otherwise(F.col(c)).alias(c)
                                       for c in tokens])


def pair_scores(pairs: DataFrame, keys: list[str], metrics=PAIR_METRICS,
                pred: str = "prediction", ref: str = "reference", stems: DataFrame | None = None,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Per-pair metric table as one projection (no shuffle).

    * bleu1 (E2), rouge1 / rouge2 (E4): clipped multiset overlaps of tokens or
      bigrams, native; rouge_l (E3, reference tokens) and rougeL (E4, rouge-score
      tokens): LCS by an Arrow UDF (functions/pairstats.py) -- the only Python step.
    * exact_match (E5), word_f1 (E6, ``array_intersect``): row expressions.
    Token arrays are materialised once as columns and shared by all metrics.
    With ``stems``, the rouge-score tokens are stemmed first (``stem_tokens``).
    ``carry`` columns (e.g. latency, token counts) pass through, so no join back is needed.
    """
    metrics = [m for m in PAIR_METRICS if m in metrics]
    need_ref = any(m in ("bleu1", "rouge_l", "word_f1") for m in metrics)
    need_rs = any(m in ("rouge1", "rouge2", "rougeL") for m in metrics)
    cols = list(keys) + [c for c in carry if c not in keys]
    if need_ref:
        cols += [lower_tokens(pred).alias("_pl"), lower_tokens(ref).alias("_rl")]
    if need_rs:
        if stems is None:
            cols += [rouge_tokens(pred).alias("_pr"), rouge_tokens(ref).alias("_rr")]
        else:
            pairs = stem_tokens(pairs, keys, {"_pr": pred, "_rr": ref}, stems)
            cols += ["_pr", "_rr"]
    if "exact_match" in metrics:
        cols.append(exact_match(pred, ref).alias("exact_match"))
    staged = pairs.select(*cols)
    stats = {"bleu1": lambda: overlap(F.col("_pl"), F.col("_rl")), "rouge_l": lambda: lcs(F.col("_pl"), F.col("_rl")),
             "rouge1": lambda: overlap(F.col("_pr"), F.col("_rr")), "rougeL": lambda: lcs(F.col("_pr"), F.col("_rr")),
             "rouge2": lambda: overlap(bigrams(F.col("_pr")), bigrams(F.col("_rr")))}
    staged = staged.withColumns({f"_st_{m}": stats[m]() for m in metrics if m in stats})

    def n_grams(arr: str, n: int) -> Column:
        return F.greatest(F.size(arr) - (n - 1), F.lit(0))

    out = []
    for m in metrics:
        if m == "bleu1":
            n_p, n_r = F.size("_pl"), F.size("_rl")
            out.append(F.when((n_p == 0) | (n_r == 0), F.lit(0.0))
                       .otherwise(F.col("_st_bleu1").cast("double") / n_p).alias("bleu1"))
        elif m in ("rouge1", "rouge2"):
            n = 1 if m == "rouge1" else 2
            ov = F.col(f"_st_{m}").cast("double")
            p = ov / F.greatest(n_grams("_pr", n), F.lit(1))
            r = ov / F.greatest(n_grams("_rr", n), F.lit(1))
            out.append(_f(p, r).alias(m))
        elif m == "rouge_l":
            out.append(_lcs_score(F.col("_st_rouge_l"), F.size("_pl"), F.size("_rl"), True).alias("rouge_l"))
        elif m == "rougeL":
            out.append(_lcs_score(F.col("_st_rougeL"), F.size("_pr"), F.size("_rr"), False).alias("rougeL"))
        elif m == "word_f1":
            out.append(word_f1_from_counts(F.size(F.array_intersect("_pl", "_rl")), F.size("_pl"), F.size("_rl")).alias("word_f1"))
        else:
            out.append(F.col(m))
    return staged.select(*keys, *[c for c in carry if c not in keys], *out)


def prediction_sheet(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per generation with rounded latency and scores (``pair_scores`` with the texts carried)."""
    return scored.select(
        *keys, "prompt", F.col("reference").alias("ground_truth"), "prediction", round2("latency_ms").alias("latency_ms"),
        F.col("tokens").alias("tokens_generated"), *[round4(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")], "exact_match")


def bleu1_pairs(pairs: DataFrame, keys: list[str], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """E2 per pair: clipped unigram precision, lower-cased, no brevity penalty; empty side -> 0."""
    return pair_scores(pairs, keys, ["bleu1"], pred, ref)


def rouge_n_pairs(pairs: DataFrame, keys: list[str], n: int, pred: str = "prediction",
                  ref: str = "reference", out: str | None = None) -> DataFrame:
    """ROUGE-n F-measure on the rouge-score token rule (no stemming), n in {1, 2}."""
    m = f"rouge{n}"
    return pair_scores(pairs, keys, [m], pred, ref).withColumnRenamed(m, out or m)


def rouge_l_pairs(pairs: DataFrame, keys: list[str], pred: str = "prediction", ref: str = "reference",
                  rouge_score_tokens: bool = False, out: str = "rouge_l") -> DataFrame:
    """E3 (reference tokens) or E4's ROUGE-L (rouge-score tokens): LCS F-measure per pair."""
    m = "rougeL" if rouge_score_tokens else "rouge_l"
    return pair_scores(pairs, keys, [m], pred, ref).withColumnRenamed(m, out)


def exact_match(pred="prediction", ref="reference") -> Column:
    """E5: equality after lower-case and strip."""
    return (ustrip(F.lower(_c(pred))) == ustrip(F.lower(_c(ref)))).cast("double")


def word_f1_from_counts(common: Column, n_pred: Column, n_ref: Column) -> Column:
    """Common distinct lower-cased words over each side's word count (floored at 1)."""
    p = common.cast("double") / F.greatest(n_pred, F.lit(1))
    r = common.cast("double") / F.greatest(n_ref, F.lit(1))
    return F.when(p + r > 0, (F.lit(2.0) * p * r) / (p + r)).otherwise(F.lit(0.0))


def word_set_f1_pairs(pairs: DataFrame, keys: list[str], pred: str = "prediction",
                      ref: str = "reference") -> DataFrame:
    """E6 per pair."""
    return pair_scores(pairs, keys, ["word_f1"], pred, ref)


# ------------------------------------------------------------ classification
def _norm(col) -> Column:
    return F.lower(ustrip(F.coalesce(_c(col), F.lit(""))))


def confusion(df: DataFrame, group: list[str], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """One ``groupBy`` builds the whole confusion table (instead of a pass per class)."""
    return (df.select(*group, _norm(ref).alias("ref_label"), _norm(pred).alias("pred_label"))
            .groupBy(*group, "ref_label", "pred_label").agg(F.count(F.lit(1)).alias("n")))


def class_report(df: DataFrame, group: list[str], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Per class (classes come from references): tp, fp, fn, precision, recall (0 if undefined)."""
    return class_report_from_confusion(confusion(df, group, pred, ref), group)


def class_report_from_confusion(cm: DataFrame, group: list[str]) -> DataFrame:
    by_ref = cm.groupBy(*group, F.col("ref_label").alias("label")).agg(
        F.sum("n").alias("ref_total"),
        F.sum(F.when(F.col("ref_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cm.groupBy(*group, F.col("pred_label").alias("label")).agg(F.sum("n").alias("pred_total"))
    j = by_ref.join(by_pred, group + ["label"], "left")
    tp = F.col("tp")
    fp = F.coalesce(F.col("pred_total"), F.lit(0)) - tp
    fn = F.col("ref_total") - tp
    return j.select(*group, "label", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                    fn.cast("long").alias("fn"),
                    F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
                    F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"))


def macro_scores(df: DataFrame, group: list[str], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Accuracy, macro precision/recall, and F1 = harmonic mean of the macro values.

    Everything comes from the confusion table (classes^2 rows per group), so the
    predictions are scanned and shuffled once.
    """
    cm = confusion(df, group, pred, ref)
    acc = cm.groupBy(*group).agg(
        (F.sum(F.when(F.col("ref_label") == F.col("pred_label"), F.col("n")).otherwise(0)).cast("double")
         / F.sum("n")).alias("accuracy"))
    rep = class_report_from_confusion(cm, group).groupBy(*group).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return acc.join(rep, group, "left").select(
        *group, "accuracy", F.coalesce(p, F.lit(0.0)).alias("precision"),
        F.coalesce(r, F.lit(0.0)).alias("recall"),
        F.when(p + r > 0, (F.lit(2.0) * p * r) / (p + r)).otherwise(0.0).alias("f1_score"))


# ---------------------------------------------------------------- summaries
def generation_summary(pairs: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """E10 (generation): mean BLEU-1 and ROUGE-L per group, 4 dp; classification fields null."""
    sc = pair_scores(pairs, keys, ["bleu1", "rouge_l"])
    extra = [c for c in group if c not in keys]
    g = pairs.select(*keys, *extra).join(sc, keys) if extra else sc
    null = F.lit(None).cast("double")
    return g.groupBy(*group).agg(
        F.lit(GENERATION).alias("task_type"), round4(F.avg("bleu1")).alias("bleu"),
        round4(F.avg("rouge_l")).alias("rouge_l"), null.alias("bert_score"), null.alias("accuracy"),
        null.alias("precision"), null.alias("recall"), null.alias("f1_score"))


def classification_summary(df: DataFrame, group: list[str]) -> DataFrame:
    """E10 (classification): accuracy, macro P/R/F1 per group, 4 dp; generation fields null."""
    m = macro_scores(df, group)
    null = F.lit(None).cast("double")
    return m.select(*group, F.lit(CLASSIFICATION).alias("task_type"), null.alias("bleu"),
                    null.alias("rouge_l"), null.alias("bert_score"),
                    round4("accuracy").alias("accuracy"), round4("precision").alias("precision"),
                    round4("recall").alias("recall"), round4("f1_score").alias("f1_score"))


def primary_metric(summary: DataFrame) -> Column:
    """Bleu for generation, accuracy for classification; null -> 0."""
    return F.coalesce(F.when(F.col("task_type") == GENERATION, F.col("bleu")).otherwise(F.col("accuracy")),
                      F.lit(0.0))


def run_aggregates(scored: DataFrame, group: list[str]) -> DataFrame:
    """Mean latency, throughput = sum tokens / sum latency (s), mean ROUGE/EM, sample count."""
    n = F.count(F.lit(1))
    lat = F.sum(F.col("latency_ms").cast("double"))
    return scored.groupBy(*group).agg(
        round2(lat / F.greatest(n, F.lit(1))).alias("avg_latency_ms"),
        F.when(lat > 0, round2(F.sum(F.col("tokens").cast("double")) / (lat / 1000))).otherwise(0.0)
        .alias("avg_throughput_tps"),
        round4(F.sum("rouge1") / F.greatest(n, F.lit(1))).alias("mean_rouge1"),
        round4(F.sum("rouge2") / F.greatest(n, F.lit(1))).alias("mean_rouge2"),
        round4(F.sum("rougeL") / F.greatest(n, F.lit(1))).alias("mean_rougeL"),
        round4(F.sum("exact_match") / F.greatest(n, F.lit(1))).alias("mean_exact_match"),
        F.greatest(n, F.lit(1)).cast("long").alias("total_samples"))


def preview_text(col, width: int = 50) -> Column:
    """Newlines -> spaces, cut at ``width`` characters + '...'."""
    t = F.translate(F.coalesce(_c(col), F.lit("")), "\n", " ")
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


METRIC_FIELDS = ["bleu", "rouge_l", "bert_score", "accuracy", "precision", "recall", "f1_score"]


def metrics_long(summary: DataFrame, group: list[str]) -> DataFrame:
    """(metric upper-cased, value 4 dp) for each non-null metric."""
    arr = F.array(*[F.struct(F.lit(m.upper()).alias("metric"), F.col(m).alias("value")) for m in METRIC_FIELDS])
    return (summary.select(*group, F.explode(arr).alias("_m"))
            .select(*group, "_m.metric", round4("_m.value").alias("value"))
            .filter(F.col("value").isNotNull()))
