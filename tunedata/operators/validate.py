"""Dataset audit (V1-V10): missing values, duplicates, severity rules, chat schema.

One Spark table may hold many datasets; every audit takes an optional
``dataset_col`` and reports per dataset in one pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.functions.text import WS_CLASS, is_missing, ustrip
from tunedata.plans.ordered import position_by_rows
from tunedata.sources.files import PLACE, row_numbers, text_lines

# Severities, the columns an instruction record needs, chat roles,
# and the texts of the audit issues (printf formats).
INFO, WARNING, ERROR = "info", "warning", "error"
REQUIRED_FIELDS = ["instruction", "output"]
OPTIONAL_FIELDS = ["input"]
CHAT_ROLES = ["system", "user", "assistant"]
MSG_EMPTY = "Dataset file contains no parsed records."
MSG_MISSING_HEADER = "Dataset lacks required fine-tuning column header: '%s'"
MSG_MISSING_INSTRUCTION = "Found %d records with null or empty 'instruction' fields."
MSG_MISSING_OUTPUT = "Found %d records with null or empty 'output' fields."
MSG_DUPLICATES = "Found %d duplicate row entries."
MSG_MISSING_INPUT = "Found %d records with empty or omitted optional 'input' values."

ISSUE_SCHEMA = "severity string, message string, affected_field string"


def _group(df: DataFrame, dataset_col: str | None):
    if dataset_col is None:
        return df.withColumn("_ds", F.lit("dataset")), "_ds"
    return df, dataset_col


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def row_fingerprint(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """128-bit fingerprint of a row: all columns as text, in sorted column order.

    Mirrors the reference's ``sorted((k, str(v)))`` identity (so 1 and "1" are
    equal).  Nulls are left out of the JSON text, so a null and an absent key
    are the same; the text "None" stays distinct from null.  Only the 16-byte
    hash is shuffled, never the wide text.
    """
    cols = sorted(c for c in df.columns if c not in exclude)
    payload = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]))
    return F.unhex(F.md5(payload))


def missing_counts(df: DataFrame, dataset_col: str | None = None, _keep: bool = False) -> DataFrame:
    """V3: rows and null-or-blank counts of instruction / output / input, one pass."""
    d, g = _group(df, dataset_col)
    out = d.groupBy(g).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_missing(_col_or_null(d, "instruction"))).alias("missing_instruction"),
        F.count_if(is_missing(_col_or_null(d, "output"))).alias("missing_output"),
        F.count_if(is_missing(_col_or_null(d, "input"))).alias("missing_input"))
    return out.drop("_ds") if dataset_col is None and not _keep else out


def duplicate_count(df: DataFrame, dataset_col: str | None = None, _keep: bool = False) -> DataFrame:
    """Rows minus distinct row fingerprints, per dataset.

    The fingerprint count is partially aggregated before the shuffle, so a
    fingerprint repeated in a third of the table collapses map-side.
    """
    d, g = _group(df, dataset_col)
    fp = d.select(g, row_fingerprint(d, exclude=(g,)).alias("_fp"))
    per_fp = fp.groupBy(g, "_fp").agg(F.count(F.lit(1)).alias("_n"))
    out = per_fp.groupBy(g).agg(F.sum(F.col("_n") - 1).cast("long").alias("duplicate_count"))
    return out.drop("_ds") if dataset_col is None and not _keep else out


def fingerprint_stats(df: DataFrame, dataset_col: str | None, sums: dict[str, Column]) -> DataFrame:
    """Row count, duplicate count and extra per-row sums per dataset in one pipeline.

    Level 1 groups by (dataset, row fingerprint) -- partially aggregated, so a
    row repeated in a third of the table collapses map-side and only the
    16-byte fingerprint plus a few sums are shuffled.  Level 2 folds the
    fingerprints of a dataset: rows = sum(k), duplicates = sum(k - 1).
    No join between separate aggregates is needed.
    """
    d, g = _group(df, dataset_col)
    per_fp = d.groupBy(g, row_fingerprint(d, exclude=(g,)).alias("_fp")).agg(
        F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(n) for n, c in sums.items()])
    folds = [F.coalesce(F.sum("_k"), F.lit(0)).cast("long").alias("n_rows"),
             F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("long").alias("duplicate_count"),
             *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums]]
    if dataset_col is None:
        # a global aggregate: one row even for an empty input (the all-zero profile)
        return per_fp.agg(*folds).withColumn("_ds", F.lit("dataset"))
    return per_fp.groupBy(g).agg(*folds)


def audit_counts(df: DataFrame, dataset_col: str | None = None) -> DataFrame:
    """One row per dataset with every count the severity rules need."""
    g = dataset_col or "_ds"
    d = df if dataset_col else df.withColumn("_ds", F.lit("dataset"))
    flags = {f"missing_{c}": is_missing(_col_or_null(d, c)).cast("long") for c in ("instruction", "output", "input")}
    st = fingerprint_stats(df, dataset_col, flags)
    present = set(df.columns)
    out = st.select(
        g, "n_rows", *[F.col(n).cast("long").alias(n) for n in flags], "duplicate_count",
        *[F.lit(f in present).alias(f"has_{f}") for f in REQUIRED_FIELDS])
    return out.drop("_ds") if dataset_col is None else out


def _issue(sev: Column, msg: Column, field: str) -> Column:
    return F.struct(sev.alias("severity"), msg.alias("message"), F.lit(field).alias("affected_field"))


def issue_array() -> Column:
    """V1, V2, V5: the issues of one dataset as an array, from its counts (``audit_counts``).

    Empty dataset -> one ERROR and nothing else (the reference returns early).
    """
    n = F.col("n_rows")

    def level(missing: str) -> Column:
        return F.when(F.col(missing) == n, F.lit(ERROR)).otherwise(F.lit(WARNING))

    header_issues = [
        F.when(~F.col(f"has_{f}"), _issue(F.lit(ERROR), F.lit(MSG_MISSING_HEADER % f), f))
        for f in REQUIRED_FIELDS]
    row_issues = [
        F.when(F.col("missing_instruction") > 0, _issue(level("missing_instruction"), F.format_string(
            MSG_MISSING_INSTRUCTION, F.col("missing_instruction")), "instruction")),
        F.when(F.col("missing_output") > 0, _issue(level("missing_output"), F.format_string(
            MSG_MISSING_OUTPUT, F.col("missing_output")), "output")),
        F.when(F.col("duplicate_count") > 0, _issue(F.lit(WARNING), F.format_string(
            MSG_DUPLICATES, F.col("duplicate_count")), "records")),
        F.when(F.col("missing_input") > 0, _issue(F.lit(INFO), F.format_string(
            MSG_MISSING_INPUT, F.col("missing_input")), "input")),
    ]
    empty = F.array(_issue(F.lit(ERROR), F.lit(MSG_EMPTY), "records"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, empty).otherwise(
        F.filter(F.array(*header_issues, *row_issues), lambda x: x.isNotNull()))


def issues_of(severity: str) -> Column:
    """Number of issues of one severity in the array ``issues``."""
    return F.size(F.filter("issues", lambda x: x["severity"] == severity)).cast("long")


def issues_from_counts(counts: DataFrame, dataset_col: str | None = None) -> DataFrame:
    """The issues as rows."""
    keys = [dataset_col] if dataset_col else []
    all_issues = issue_array()
    return (counts.select(*keys, F.posexplode(all_issues).alias("issue_no", "issue"))
            .select(*keys, "issue_no", "issue.severity", "issue.message", "issue.affected_field"))


def validation_issues(df: DataFrame, dataset_col: str | None = None,
                      catalog: DataFrame | None = None) -> DataFrame:
    """Issue rows per dataset.  ``catalog`` (one column, the dataset ids) adds
    the datasets that have no rows at all, so that they get the empty ERROR."""
    counts = audit_counts(df, dataset_col)
    if catalog is not None and dataset_col:
        counts = catalog.select(dataset_col).distinct().join(counts, dataset_col, "left")
    return issues_from_counts(counts, dataset_col)


def validation_report(df: DataFrame, dataset_col: str | None = None,
                      catalog: DataFrame | None = None) -> DataFrame:
    """V6: is_valid = no ERROR issue, with issue counts by severity (every dataset)."""
    g = dataset_col or "_ds"
    counts = audit_counts(df.withColumn("_ds", F.lit("dataset")) if dataset_col is None else df, g)
    if catalog is not None and dataset_col:
        counts = catalog.select(dataset_col).distinct().join(counts, dataset_col, "left")
    marked = counts.select(g, issue_array().alias("issues"))
    out = marked.select(g, (issues_of(ERROR) == 0).alias("is_valid"), F.size("issues").cast("long").alias("n_issues"),
                        issues_of(ERROR).alias("n_errors"), issues_of(WARNING).alias("n_warnings"), issues_of(INFO).alias("n_info"))
    return out.drop("_ds") if dataset_col is None else out


def ingest_gate(report: DataFrame, dataset_col: str) -> DataFrame:
    """Datasets with an ERROR stop in state 'validated'; the rest go on."""
    return report.select(dataset_col, "is_valid",
                         F.when(F.col("is_valid"), F.lit("ready")).otherwise(F.lit("validated"))
                         .alias("final_state"))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """V8: mapped-column presence check (schema only, raises)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Required column(s) {missing} missing. Available: {df.columns}")


# ----------------------------------------------------------------- chat audit
def chat_turn_violations(df: DataFrame, key_col: str, messages_col: str = "messages") -> DataFrame:
    """V7/V9 on a typed ``messages`` column: one row per (record, turn, rule) broken.

    Rules: messages present and a list of >= 2 turns; each turn has role and
    content; role in {system, user, assistant}; content a non-blank string.
    Turn-level checks explode the array, so the work is spread by record.
    """
    m = F.col(messages_col)
    record = df.select(key_col, F.when(m.isNull(), F.lit("missing_messages"))
                       .when(F.size(m) < 2, F.lit("too_few_turns")).alias("rule"),
                       F.lit(None).cast("int").alias("turn_index"))
    record = record.filter(F.col("rule").isNotNull())
    turns = df.select(key_col, F.posexplode(m).alias("turn_index", "t"))
    role, content = F.col("t.role"), F.col("t.content")
    rules = F.array(
        F.when(role.isNull() | content.isNull(), F.lit("missing_role_or_content")),
        F.when(role.isNotNull() & ~role.isin(*CHAT_ROLES), F.lit("invalid_role")),
        F.when(content.isNotNull() & (ustrip(content) == ""), F.lit("blank_content")))
    per_turn = (turns.select(key_col, "turn_index", F.explode(F.filter(rules, lambda r: r.isNotNull()))
                             .alias("rule")).select(key_col, "rule", "turn_index"))
    return record.unionByName(per_turn)


def chat_turn_violations_long(turns: DataFrame, key_col: str, order_col: str = "turn",
                              role_col: str = "role", content_col: str = "text") -> DataFrame:
    """V7 over turn-per-row conversations: the same rules, no conversation array built.

    The turn index is the turn's position in the conversation: by turn number (nulls first; numbers need not be dense), ties by
    role and the md5 of the content.  A null key is a conversation like others.  Rules are checked before rows are
    ordered, so no text is moved.
    """
    role, content = F.col(role_col), F.col(content_col)
    rules = F.array(
        F.when(role.isNull() | content.isNull(), F.lit("missing_role_or_content")),
        F.when(role.isNotNull() & ~role.isin(*CHAT_ROLES), F.lit("invalid_role")),
        F.when(content.isNotNull() & (ustrip(content) == ""), F.lit("blank_content")))
    narrow = turns.select(F.col(key_col).alias("_key"), F.col(order_col).alias("_turn"), role.alias("_role"), F.md5(content).alias("_digest"),
                          F.filter(rules, lambda r: r.isNotNull()).alias("_rules"))
    rec = (narrow.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < 2)
           .select(F.col("_key").alias(key_col), F.lit("too_few_turns").alias("rule"), F.lit(None).cast("int").alias("turn_index")))
    placed = position_by_rows(narrow, ["_key"], ["_turn", "_role", "_digest"], "_index")
    return rec.unionByName(placed.select(F.col("_key").alias(key_col), F.explode("_rules").alias("rule"), F.col("_index").cast("int").alias("turn_index")))


def assert_chat_schema(violations: DataFrame, *key_cols: str) -> None:
    """V7 ``fail_fast``: raise on the first violation by ``key_cols`` (only one row is brought to the driver)."""
    first = violations.orderBy(*key_cols, F.col("turn_index").asc_nulls_first()).limit(1).collect()
    if first:
        r = first[0]
        where = "" if r["turn_index"] is None else f" in turn {r['turn_index']}"
        record = ", ".join(f"{c} {r[c]}" for c in key_cols)
        raise ValueError(f"Dataset schema error: rule '{r['rule']}' broken by {record}{where}")


def chat_text_violations(lines: DataFrame, key_col: str, value_col: str = "value") -> DataFrame:
    """V7 on raw JSONL text: one row per (record, turn, rule) broken, types as written in the file.

    Lines are parsed as VARIANT and nothing is cast: a number or an object is no text content.
    Rules of a record: ``invalid_json``, ``missing_messages``, ``messages_not_list``, ``too_few_turns``;
    of a turn: ``turn_not_object``, ``missing_role_or_content`` (a key is absent), ``invalid_role`` (also
    null), ``content_not_string`` (also null), ``blank_content``.  Blank lines are skipped.
    """
    parsed = lines.filter(ustrip(F.col(value_col)) != "").select(key_col, F.try_parse_json(F.col(value_col)).alias("_v"))
    parsed = parsed.withColumn("_m", F.expr("try_variant_get(_v, '$.messages', 'variant')"))
    is_list = F.expr("startswith(schema_of_variant(_m), 'ARRAY')")
    turns = F.when(is_list, F.expr("try_variant_get(_m, '$', 'array<variant>')"))
    typed = parsed.select(key_col, "_v", "_m", turns.alias("_turns"))
    record_rule = (F.when(F.col("_v").isNull(), F.lit("invalid_json"))
                   .when(F.col("_m").isNull(), F.lit("missing_messages"))
                   .when(F.col("_turns").isNull(), F.lit("messages_not_list"))
                   .when(F.size("_turns") < 2, F.lit("too_few_turns")))
    bad = typed.select(key_col, record_rule.alias("rule"), F.lit(None).cast("int").alias("turn_index")) \
        .filter(F.col("rule").isNotNull())

    def kind(path: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(_t, '{path}', 'variant'))")
    each = (typed.select(key_col, F.posexplode("_turns").alias("turn_index", "_t"))
            .select(key_col, "turn_index", F.coalesce(kind("$"), F.lit("VOID")).alias("_kind"), kind("$.role").alias("_role"),
                    kind("$.content").alias("_content"), F.expr("try_variant_get(_t, '$.role', 'string')").alias("_r"),
                    F.expr("try_variant_get(_t, '$.content', 'string')").alias("_c")))
    is_object = F.col("_kind").startswith("OBJECT")
    no_role = (F.col("_role") != "STRING") | ~F.col("_r").isin(*CHAT_ROLES)
    rules = F.array(
        F.when(~is_object, F.lit("turn_not_object")),
        F.when(is_object & (F.col("_role").isNull() | F.col("_content").isNull()), F.lit("missing_role_or_content")),
        F.when(is_object & no_role, F.lit("invalid_role")),
        F.when(is_object & (F.col("_content") != "STRING"), F.lit("content_not_string")),
        F.when(is_object & (F.col("_content") == "STRING") & (ustrip(F.col("_c")) == ""), F.lit("blank_content")))
    per_turn = each.select(key_col, "turn_index", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return bad.unionByName(per_turn.select(key_col, "rule", "turn_index"))


def chat_file_violations(spark: SparkSession, path: str) -> DataFrame:
    """V7 on JSONL files: (file, line, rule, turn_index) of every rule that a line breaks."""
    scan = text_lines(spark, path)
    broken = chat_text_violations(scan.select(F.struct(*PLACE).alias("_k"), "value"), "_k").select("_k.*", "rule", "turn_index")
    return row_numbers(broken, scan).withColumnRenamed("_file", "file")


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """V7: files without a byte below ``path``, from the folder listing (a Spark scan skips such files)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


__all__ = ["missing_counts", "duplicate_count", "audit_counts", "validation_issues", "validation_report",
           "ingest_gate", "require_columns", "chat_turn_violations", "chat_text_violations", "chat_file_violations", "empty_files",
           "row_fingerprint", "WS_CLASS", "is_missing"]
