"""Line de-duplication with per-document keep bitmaps.

1. Every whole text is split into lines; a line of at least ``min_chars`` code
   points (after stripping ASCII white space) becomes (128-bit key hash,
   document, position).  The text itself goes no further.
2. Hot keys are found by a pre-aggregated count: a key with more rows than
   a quarter of an average partition.  There are at most ``4 * partitions`` of
   them, so their verdicts (number of documents, keeper) are broadcast, and their
   rows are decided where they are.
3. All other rows are range-partitioned by key hash and sorted by document
   (largest first) and position within the key: one pass streams each key's
   first occurrence, which names the keeper, and the number of documents.
4. The dropped positions become a bitmap per document: 64-line words, and only
   the words with a dropped line (a document without any has no entry).
5. The bitmaps join the documents by (id, text hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.llm.common import WS, ascii_lower, fan_out, let, lines_of, staged, text_of

ROW = ["_id", "_txt"]


def line_key(line: Column) -> Column:
    return F.trim(ascii_lower(line), F.lit(WS))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text hash, position, key hashes) of every line long enough to be compared."""
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_txt"), F.posexplode(lines_of(text)).alias("_pos", "_line"))
    keys = lines.select("_id", "_txt", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keys.select("_id", "_txt", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, text hash, position) of every line to drop."""
    spark = docs.sparkSession
    parts = fan_out(spark)
    rows = staged(line_rows(docs, id_col, text_col, min_chars), "line-rows")
    total = rows.count()
    key = ["_h1", "_h2"]
    # at most 4 * parts keys can have more rows than this
    hot = rows.groupBy(*key).count().where(F.col("count") > max(total // (4 * parts), min_docs)).select(*key)
    hot = staged(hot, "line-hot-keys")
    verdict = (rows.join(F.broadcast(hot), key).groupBy(*key)
               .agg(F.count_distinct(F.struct("_id")).alias("_docs"), F.max("_id").alias("_keeper")))
    verdict = staged(verdict.where(F.col("_docs") >= min_docs), "line-hot-verdicts")
    heavy = rows.join(F.broadcast(verdict), key).where(~F.col("_id").eqNullSafe(F.col("_keeper"))).select(*ROW, "_pos")

    light = rows.join(F.broadcast(hot), key, "left_anti").repartitionByRange(parts, *key)
    run = Window.partitionBy(*key).orderBy(F.col("_id").desc_nulls_last(), "_pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("_id")).over(run)
    light = (light.withColumn("_new", F.when(before.isNull() | ~before["_id"].eqNullSafe(F.col("_id")), 1).otherwise(0))
             .withColumns({"_docs": F.sum("_new").over(whole), "_keeper": F.first("_id").over(whole)})
             .where((F.col("_docs") >= min_docs) & ~F.col("_id").eqNullSafe(F.col("_keeper"))).select(*ROW, "_pos"))
    return light.unionByName(heavy)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per document: the 64-line words that have dropped lines, as (word, mask of dropped lines)."""
    words = (dropped.groupBy(*ROW, F.floor(F.col("_pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("mask")))
    return words.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("_bits"))


def _kept_text(text: Column, bits: Column) -> Column:
    """The lines whose bit is not set, joined again; linear in the number of lines."""
    def apply(s: Column) -> Column:
        kept = F.filter(s["l"], lambda x, i: F.getbit(F.get(s["w"], F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 0)
        return F.array_join(kept, "\n")

    def dense(s: Column) -> Column:
        n = F.floor((F.size(s["l"]) - 1) / 64).cast("int")
        words = F.transform(F.sequence(F.lit(0), n), lambda w: F.coalesce(F.element_at(s["m"], w), F.lit(0).cast("long")))
        return F.struct(s["l"].alias("l"), words.alias("w"))

    raw = F.struct(lines_of(text).alias("l"), F.map_from_entries(bits).alias("m"))
    return let(raw, lambda s: let(dense(s), apply))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` and ``n_lines``, ``n_dropped``, ``kept_text``, ``drop_bits``.

    A key is a line with ASCII white space stripped at both ends and A-Z
    lower-cased.  A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses all its lines except those in the largest id.
    ``drop_bits`` is the compressed bitmap (null: nothing dropped).

    Null text counts as empty: one empty line, nothing dropped.  Rows with equal id
    are one document for the counts and all of them keep or lose the line.  The null
    id is one document, below every other.  Result columns replace input columns of
    the same name.  An empty table gives an empty result.
    """
    bits = keep_bitmaps(dropped_lines(docs, id_col, text_col, min_chars, min_docs))
    bits = bits.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("__line_id"), F.col("_id").isNull().alias("__line_null"),
                       F.col("_txt").alias("__line_txt"), F.col("_bits").alias("__line_bits"))
    text = text_of(text_col)
    keyed = docs.withColumns({"__line_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                              "__line_null": F.col(id_col).isNull(), "__line_txt": F.xxhash64(text)})
    out = keyed.join(bits, ["__line_id", "__line_null", "__line_txt"], "left")
    masks = F.transform(F.col("__line_bits"), lambda b: F.bit_count(b["mask"]).cast("long"))
    added = {"n_lines": F.size(lines_of(text)).cast("long"),
             "n_dropped": F.coalesce(F.aggregate(masks, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
             "kept_text": F.when(F.col("__line_bits").isNull(), text).otherwise(_kept_text(text, F.col("__line_bits"))),
             "drop_bits": F.col("__line_bits")}
    return out.withColumns(added).drop("__line_id", "__line_null", "__line_txt", "__line_bits")
