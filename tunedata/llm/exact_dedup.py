"""Exact de-duplication by a tree merge of sorted digest runs.

Every input partition is a *run*: its rows are reduced to one entry per text
(digest, verification fields, best row, number of rows).  The runs then merge in
rounds.  A node number has one digit per round; in round ``r`` every node sends
each entry to the node whose digit ``r`` is the digest's digit ``r`` and keeps
its other digits, so a node receives entries of ``radix`` nodes (two make the
binomial tree, more make a multiway merge).  After the last round the digest
alone names the node and each text is one entry.  The way back sends the final
entry down the same edges.

Why it holds for hot texts: a text that fills a third of the table is one entry
per run from the start, and no join sees more than the rows of one run under one
key.  No node ever holds more than its share of the digests.

An entry is keyed by SHA-256, byte length and an independent 64-bit hash of the
normalised text, so two rows merge only when all three agree (verified at every
level, since every level groups by all of them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import ascii_lower, fan_out, staged, text_of

KEY = ["_sha", "_len", "_chk"]


def _best(keep: str) -> Column:
    if keep == "max":          # a null id sorts below every id
        return F.max("_row")
    if keep == "min":          # a null id sorts above every id
        return F.min("_row")
    raise ValueError("keep must be 'min' or 'max'")


def _row(keep: str) -> Column:
    if keep == "max":
        return F.struct(F.col("_id"), F.col("_rid"))
    return F.struct(F.col("_id").isNull().alias("_nul"), F.col("_id"), F.col("_rid"))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest fields, run (input partition) and a row number."""
    norm = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_norm"))
    return norm.select("_id", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.octet_length("_norm").alias("_len"),
                       F.xxhash64("_norm").alias("_chk"), F.spark_partition_id().alias("_run"),
                       F.monotonically_increasing_id().alias("_rid"))


def _digit(sha: str, r: int, radix: int) -> Column:
    """Digit ``r`` of the digest: a 32-bit slice (other slices for other rounds) modulo the radix."""
    part = F.conv(F.hex(F.substring(F.col(sha), 1 + 4 * (r % 7), 4)), 16, 10).cast("long")
    return F.pmod(part, F.lit(radix))


def merge_runs(rows: DataFrame, keep: str = "max", radix: int | None = None, rounds: int = 2) -> DataFrame:
    """(``_node0``, digest) -> ``_best`` row and ``_n`` rows of the text in the whole table.

    ``rows`` needs ``_node0`` (the run, below ``radix ** rounds``), the digest fields and ``_row``.
    """
    def place(level: int, df: DataFrame) -> DataFrame:
        """Send to the node of ``level + 1``: its digit ``level`` becomes the digest's."""
        unit = radix ** level
        old = F.floor(F.col(f"_node{level}") / unit) % radix
        return df.withColumn(f"_node{level + 1}", (F.col(f"_node{level}") + (_digit("_sha", level, radix) - old) * unit).cast("int"))

    nodes = radix ** rounds
    levels = [place(0, rows.groupBy("_node0", *KEY).agg(_best(keep).alias("_row"), F.count(F.lit(1)).alias("_n")))]
    for r in range(1, rounds + 1):
        node = f"_node{r}"
        inbox = levels[-1].repartitionById(nodes, F.col(node)).sortWithinPartitions(node, *KEY)
        merged = inbox.groupBy(node, *KEY).agg(_best(keep).alias("_row"), F.sum("_n").alias("_n"))
        levels.append(place(r, merged) if r < rounds else merged)
    final = levels[-1].withColumnsRenamed({"_row": "_best"})
    for r in range(rounds, 0, -1):
        below = levels[r - 1].select(f"_node{r - 1}", f"_node{r}", *KEY)
        final = below.join(final, [f"_node{r}", *KEY]).select(f"_node{r - 1}", *KEY, "_best", "_n")
    return final


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                radix: int | None = None, rounds: int = 2) -> DataFrame:
    """Verdict per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z.  Null text counts as
    empty, so all null and empty texts are one group.  Rows that share id and text
    are rows of their own: they count in ``group_size`` and exactly one of them is
    kept.  A null id loses against any id, and is the ``keep_id`` only where the
    group has no other.  Columns other than id and text are not looked at.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    radix = radix or max(2, math.ceil(fan_out(spark) ** (1 / rounds)))
    rows = staged(digest_rows(docs, id_col, text_col), "digest-runs")
    rows = rows.withColumn("_node0", F.pmod("_run", F.lit(radix ** rounds)).cast("int")).withColumn("_row", _row(keep))
    best = merge_runs(rows.select("_node0", "_row", *KEY), keep, radix, rounds)
    out = rows.join(best, ["_node0", *KEY])
    return out.select(F.col("_id").alias(id_col), F.col("_best._id").alias("keep_id"), F.col("_n").alias("group_size"),
                      (F.col("_rid") == F.col("_best._rid")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The kept rows with all their columns (one row per text).

    The verdicts (small) and the rows meet by (id, digest): ids spread a hot text
    over the partitions.  Rows equal in id and text cannot be told apart by that
    key, so one of them is taken.
    """
    cols, keys = docs.columns, ["__copy_id", "__copy_null", "__copy_sha"]
    kept = (mark_copies(docs, id_col, text_col, keep).where("kept")
            .select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(keys[0]), F.col(id_col).isNull().alias(keys[1]),
                    F.unhex("text_sha256").alias(keys[2])))
    rows = docs.withColumns({keys[0]: F.coalesce(F.col(id_col).cast("string"), F.lit("")), keys[1]: F.col(id_col).isNull(),
                             keys[2]: F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))})
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*cols)
