"""Exact length histogram, and totals for every context limit from suffix sums.

Texts are encoded inside the tasks, which return (length, documents) pairs summed
per Arrow batch; the histogram has one row per distinct length, however many documents there are.
Running sums over the lengths are made in two levels: blocks of ``BLOCK`` lengths are summed in
parallel, and only the block sums (longest document / BLOCK rows) are run through in
order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunedata.llm.tokens import encode, public_path

BLOCK = 64


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0)
        n = Counter(len(encode(texts[i].as_py(), path)) for i in range(b.num_rows))
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(n), pa.int64()), "n_docs": pa.array(list(n.values()), pa.int64())})


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length.  Null and empty texts have length 0; repeated rows count each."""
    path = path or public_path("byte_bpe_50k.tiktoken")
    pairs = docs.select(F.col(text_col).alias("_text")).mapInArrow(lambda it: _lengths(it, path), "n_tokens long, n_docs long")
    return pairs.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length L (a stored histogram: it is read twice):

    ``docs_ge`` / ``tokens_ge``: documents at least that long and their tokens;
    ``docs_le``: documents at most that long; ``truncated_total``: tokens of all documents
    cut at L; ``rank``: share of documents at most that long.  An empty histogram gives no rows.
    """
    rows = hist.withColumns({"_block": F.floor(F.col("n_tokens") / BLOCK), "_tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(later), zero).alias("_d"), F.coalesce(F.sum("_t").over(later), zero).alias("_t"),
                           F.sum("_d").over(every).alias("_docs"), F.sum("_t").over(every).alias("_all"))
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (rows.withColumns({"docs_ge": F.sum("n_docs").over(inside), "tokens_ge": F.sum("_tokens").over(inside)}).join(blocks, "_block")
           .withColumns({"docs_ge": F.col("docs_ge") + F.col("_d"), "tokens_ge": F.col("tokens_ge") + F.col("_t")}))
    return out.select("n_tokens", "n_docs", "docs_ge", "tokens_ge", (F.col("_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
                      (F.col("_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
                      ((F.col("_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("_docs")).alias("rank"))


def limit_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limit (also one that no document has): documents cut and tokens that remain.

    The row of the shortest length above the limit has all that is needed; one pass over the histogram answers all limits.
    """
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in limits], "max_tokens long"))
    total = F.lit(sums.agg(F.max("tokens_ge")).first()[0] or 0)
    above = (sums.join(asked, F.col("n_tokens") > F.col("max_tokens")).groupBy("max_tokens")
             .agg(F.max("docs_ge").alias("docs_cut"), F.max("tokens_ge").alias("_t")))
    out = asked.join(above, "max_tokens", "left")
    zero = F.lit(0).cast("long")
    return out.select("max_tokens", F.coalesce("docs_cut", zero).alias("docs_cut"),
                      (total - F.coalesce("_t", zero) + F.col("max_tokens") * F.coalesce("docs_cut", zero)).alias("tokens"))


def quantile_length(sums: DataFrame, q: float) -> DataFrame:
    """The shortest length that at least a share ``q`` of the documents does not exceed."""
    return sums.where(F.col("rank") >= q).agg(F.min("n_tokens").alias("n_tokens"))
