"""Registered queries: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import conversation_repair, embedding_dedup, exact_dedup, jaccard_join, license_scan, line_dedup, mixing, packing, quality_rules, secret_scan, token_counts, url_filter, vector_codes
from tunedata.llm.common import staged, table
from tunedata.llm.oracles import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(number, secret_scan.KINDS),
                      F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = staged(token_counts.length_histogram(table(spark, sf_dir, "documents")), "length-histogram")
    return token_counts.suffix_sums(hist)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: the source is the repository, ids give two directory levels, and every fifth
    document is a LICENSE file at one of the three levels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    root, a, b = F.col("source"), F.expr("'d' || doc_id div 2000"), F.expr("'e' || doc_id div 200")
    level = F.when(F.col("doc_id") % 5 != 0, F.concat_ws("/", root, a, b, F.expr("'f' || doc_id || '.txt'")))
    level = level.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", root, F.lit("LICENSE"))).when(
        F.col("doc_id") % 3 == 1, F.concat_ws("/", root, a, F.lit("LICENSE"))).otherwise(F.concat_ws("/", root, a, b, F.lit("LICENSE")))
    return license_scan.scan_licenses(docs.withColumn("path", level), "path")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = staged(docs.withColumns(mixing.sized(docs, "doc_id", "text", "source")).drop("source", "text"), "mix-sizes")
    return mixing.mix_sources(sizes, sizes).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    feats = staged(quality_rules.document_features(docs).drop("text"), "quality-features")
    out = quality_rules.judge_documents(feats)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "host_docs", "host_kept")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def damaged_turns(rows: DataFrame) -> DataFrame:
    """Turns damaged by the crc32 of ``conv_id:turn`` modulo 20 (nulls are one space): 0 gone, 1 without text, 2 without
    sentence ends, 3 twice, 4 by the user."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_d"))
    return out.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair_conversations(damaged_turns(rows))
    hashes = conversation_repair.hash_turns(found.turns)
    ids = rows.select("conv_id").distinct()

    def same(other: DataFrame) -> Column:
        return F.col("i.conv_id").eqNullSafe(other["conv_id"])
    out = ids.alias("i").join(found.conversations.alias("f"), same(found.conversations), "left").join(hashes.alias("h"), same(hashes), "left")
    zero = [F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("i.conv_id", *zero, F.coalesce("f.audit", F.lit("")).alias("audit"),
                      F.coalesce("h.sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.lit(books.text() if books else ""), 256).alias("codebooks_sha256")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)
