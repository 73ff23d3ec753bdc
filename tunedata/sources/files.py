"""Sources and sinks (S1-S16): JSON / JSONL / CSV records, content hashes, split sets, logs.

Readers are Spark's own (splittable JSONL and CSV; ``multiLine`` documents are
one task per file, so convert such inputs to parquet once).  Nothing is read
or written through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tunedata.functions.text import ustrip
from tunedata.sources import large_files

# Supported record formats, and the NA tokens of the pandas CSV
# reader (its documented defaults) for the NA-aware CSV path.
FORMATS = ("json", "jsonl", "csv", "parquet")
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CORRUPT = "_corrupt_record"
# the group of rows without one in the path of a document (the name Hive and Spark give such a folder)
NULL_GROUP = "__HIVE_DEFAULT_PARTITION__"
# JSON keeps full microsecond timestamps (Spark's default text format stops at milliseconds)
JSON_TIME_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                     "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


# ------------------------------------------------------------------ readers
def detect_format(ext: str) -> str:
    """Extension -> format; case/space-insensitive, leading dot optional."""
    e = (ext or "").strip().lower().lstrip(".")
    if e not in FORMATS:
        raise ValueError(f"no reader for the extension {ext!r}")
    return e


def read_json_document(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A JSON document per file; an array gives one row per element, an object one row.

    A document that is neither (a bare scalar) leaves only the corrupt-record
    column, which is an error as in the reference.
    """
    r = spark.read.options(**JSON_TIME_OPTIONS).option("multiLine", True).option("mode", "PERMISSIVE")
    df = (r.schema(schema) if schema is not None else r).json(path)
    if schema is None and df.columns == [CORRUPT]:
        raise ValueError(f"JSON document at {path} is neither an object nor a list")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the read (FAILFAST)."""
    r = spark.read.options(**JSON_TIME_OPTIONS).option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def read_jsonl_quarantine(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """S2 alternative: keep good lines, put malformed ones in a quarantine frame."""
    s = StructType(schema.fields + [StructType().add(CORRUPT, "string").fields[0]])
    df = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    # the quarantine keeps every column: Spark refuses a raw-file scan that reads only the corrupt column
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S3: header row, every cell a string, quoted newlines and doubled quotes allowed.

    Cells with newlines need ``multi_line``, which reads a file in one task; files without such cells
    are split by byte ranges with ``multi_line=False``.
    """
    # an empty cell is '' (not null); only a short row gives null -- as csv.DictReader does
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("inferSchema", False).option("nullValue", "\u0000").csv(path))


def apply_na(df: DataFrame, na_values=PANDAS_NA_VALUES, cols: list[str] | None = None) -> DataFrame:
    """NA tokens -> null (the pandas reader's behaviour), for string columns."""
    for c in cols or df.columns:
        df = df.withColumn(c, F.when(F.col(c).isin(*na_values), F.lit(None)).otherwise(F.col(c)))
    return df


def load_dataset(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """S5 dispatch."""
    fmt = detect_format(ext)
    if fmt == "json":
        return read_json_document(spark, path)
    if fmt == "jsonl":
        return read_jsonl(spark, path)
    if fmt == "csv":
        return read_csv(spark, path)
    return spark.read.parquet(path)


# ------------------------------------------------------------- line numbers
PLACE = ("_file", "_block", "_at")


def placed(df: DataFrame) -> DataFrame:
    """A file scan with the place of each row: file, start of its byte block, and a number that grows inside the block."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (blank ones too) with their places; files are split by bytes as always."""
    return placed(spark.read.text(path))


def row_numbers(rows: DataFrame, scan: DataFrame, out_col: str = "line") -> DataFrame:
    """``rows`` of a placed ``scan`` with their 1-based number in their file, and without the place (``_file`` stays).

    Blocks are counted on their own (a block of bytes lies in one task, in order), prefix sums give the number of rows before each
    block, and only ``rows`` are joined with them: number the few rows that are to be named, not the whole scan.  The
    block table has one row per block of 128 MB or so; the planner broadcasts it where its measured size allows.
    """
    blocks = scan.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    along = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    others = [c for c in rows.columns if c not in PLACE]
    line = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return rows.join(before, ["_file", "_block"]).select("_file", line.cast("long").alias(out_col), *others)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that hold no JSON; blank lines are skipped but counted."""
    scan = text_lines(spark, path)
    bad = scan.where((ustrip(F.col("value")) != "") & F.try_parse_json("value").isNull())
    return row_numbers(bad, scan).withColumnRenamed("_file", "file")


def check_jsonl(spark: SparkSession, path: str) -> None:
    """S2, fail fast: raise on the first line (by file and number) that holds no JSON; one row comes to the driver."""
    first = malformed_lines(spark, path).orderBy("file", "line").select("file", "line").first()
    if first:
        raise ValueError(f"{first.file}, line {first.line}: no JSON")


# ------------------------------------------------------------------ writers
def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """JSON lines (Spark does not escape non-ASCII); one directory per split if asked.

    Partitioned rows are rebalanced on the partition columns first: AQE cuts a large split into tasks of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and puts small ones together, so the number of files follows the bytes
    written, not tasks times splits.
    """
    if partition_by:
        df.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode(mode).options(**JSON_TIME_OPTIONS).partitionBy(*partition_by).json(path)
    else:
        df.write.mode(mode).options(**JSON_TIME_OPTIONS).json(path)


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """An idempotent output -- if the target already exists, the job does nothing."""
    df.write.mode("ignore").options(**(JSON_TIME_OPTIONS if fmt == "json" else {})).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with header, every field quoted."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def _frame_arrays(group_col: str | None):
    """mapInPandas body: wrap each (partition, group) run of JSON rows in '[' ... ']' lines."""
    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, current, started = 0, None, False
        for pdf in batches:
            out_g, out_s, out_v = [], [], []
            groups = pdf[group_col].tolist() if group_col else [None] * len(pdf)
            for g, j in zip(groups, pdf["_j"].tolist()):
                if started and g != current:
                    out_g.append(current), out_s.append(seq), out_v.append("]")
                    seq += 1
                    started = False
                if not started:
                    out_g.append(g), out_s.append(seq), out_v.append("[")
                    seq += 1
                    current, started, first = g, True, True
                out_g.append(g), out_s.append(seq), out_v.append(j if first else "," + j)
                seq += 1
                first = False
            yield pd.DataFrame({"_g": out_g, "_seq": out_s, "value": out_v})
        if started:
            yield pd.DataFrame({"_g": [current], "_seq": [seq], "value": ["]"]})
    return frame


def _pack_arrays(group_col: str, rows: int):
    """mapInPandas body: each run of equal groups as JSON array documents of at most ``rows`` elements, named ``<group_col>=<group>/part-<n>.json``."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        current, held = None, []

        def document() -> tuple[str, str]:
            name = NULL_GROUP if current is None else quote(current, safe="")
            return f"{group_col}={name}/part-{part:05d}-{seq:09d}.json", "[" + ",".join(held) + "]"
        for pdf in batches:
            out = []
            for g, j in zip(pdf["_g"].tolist(), pdf["_j"].tolist()):
                if held and (g != current or len(held) == rows):
                    out.append(document())
                    seq, held = seq + 1, []
                current = g
                held.append(j)
            yield pd.DataFrame(out, columns=["path", "content"])
        if held:
            yield pd.DataFrame([document()], columns=["path", "content"])
    return pack


def write_json_arrays(df: DataFrame, path: str, group_col: str | None = None, order_cols: list[str] | None = None,
                      num_partitions: int | None = None, mode: str = "error", pack: int | None = None) -> None:
    """Write JSON array documents (one per task and group) -- the format S1 / S15 read.

    Rows are range-partitioned on (group, order) so a big group spans several
    tasks (and files) instead of one; each task frames its rows with mapInPandas.

    With many small groups a file each costs more than its rows (create, commit, list, open).  ``pack`` keeps the documents and their paths
    (``<group_col>=<group>/part-<n>.json``, the group percent-encoded) but stores them as rows ``path``, ``content`` of parquet files, so
    that the number of files follows the tasks; a document holds at most ``pack`` elements, so a big group is many rows.
    """
    order_cols = order_cols or []
    cols = [c for c in df.columns if c != group_col]
    gcol = [group_col] if group_col else []
    j = df.select(*gcol, *order_cols, F.to_json(F.struct(*cols), JSON_TIME_OPTIONS).alias("_j"))
    keys = gcol + order_cols
    if keys:
        n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        j = j.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    if pack:
        if not group_col:
            raise ValueError("only documents of groups are packed")
        docs = j.select(F.col(group_col).cast("string").alias("_g"), "_j").mapInPandas(_pack_arrays(group_col, pack), "path string, content string")
        docs.write.mode(mode).parquet(path)
        return
    gtype = dict(df.dtypes)[group_col] if group_col else "string"
    framed = j.select(*gcol, "_j").mapInPandas(_frame_arrays(group_col), f"_g {gtype}, _seq long, value string")
    framed = framed.sortWithinPartitions("_g", "_seq")
    if group_col:
        framed.select(F.col("_g").alias(group_col), "value").write.mode(mode).partitionBy(group_col).text(path)
    else:
        framed.select("value").write.mode(mode).text(path)


# ------------------------------------------------------------- hashes, cache
def content_hash(col) -> F.Column:
    """S6 for rows: hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


#: files up to this length are hashed as one value each
WHOLE_FILE = 128 * 1024 * 1024


def file_hashes(spark: SparkSession, path_glob: str, whole: int = WHOLE_FILE) -> DataFrame:
    """S6 for files: SHA-256 of the file bytes.

    Files up to ``whole`` bytes come from the ``binaryFile`` source, one row each; longer ones are hashed piece by piece in rounds
    (``large_files``), so no task reads a whole one.  Without OpenSSL's library, and for files that the text reader would unpack, they
    are one row each as well, up to the 2 GB of a value.
    """
    b = spark.read.format("binaryFile").load(path_glob)
    length, packed = F.col("_metadata.file_size"), F.col("_metadata.file_name").rlike(large_files.PACKED)

    def one_row(files: DataFrame) -> DataFrame:
        return files.select("path", "length", F.sha2(F.col("content"), 256).alias("content_hash"))
    files = b.where((length > whole) & ~packed).select("path", "length", F.col("_metadata.file_path").alias("file"))
    longest, count = files.agg(F.max("length"), F.count("length")).first() if large_files.resumable() else (None, 0)
    if not count:
        return one_row(b)
    hashes = large_files.large_file_hashes(spark, path_glob, whole, longest, count)
    parts = files.join(hashes, "file").select("path", "length", "content_hash")
    # conditions on the file alone, so that the content of others is not read
    return one_row(b.where(length <= whole)).unionByName(one_row(b.where((length > whole) & packed))).unionByName(parts)


def combined_hash(hashes: DataFrame, col: str = "content_hash") -> DataFrame:
    """One row (``n``, ``one``, ``h``) for any number of hex SHA-256 values, whatever their order.

    ``h`` hashes the number of values and the sums of their eight 32-bit parts: partial sums, no list of all files.
    """
    part = [F.sum(F.conv(F.substring(col, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(8)]
    total = hashes.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("one"), *[p.alias(f"p{i}") for i, p in enumerate(part)])
    return total.select("n", "one", F.sha2(F.concat_ws(",", "n", *[f"p{i}" for i in range(8)]), 256).alias("h"))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cache_split(incoming: DataFrame, registry: DataFrame, hash_col: str = "content_hash",
                state_col: str = "lifecycle_state", ready: str = "ready") -> tuple[DataFrame, DataFrame]:
    """Inputs whose hash is registered READY (hits, skipped) and the rest (misses, processed)."""
    done = registry.filter(F.col(state_col) == ready).select(F.col("dataset_id").alias(hash_col))
    return incoming.join(done, hash_col, "left_semi"), incoming.join(done, hash_col, "left_anti")


# Provenance tag of hub datasets (source "huggingface:<repo>", name with '/' -> '_').
HUB_PREFIX = "huggingface:"


def provenance(repo_col) -> tuple[F.Column, F.Column]:
    """(dataset_name, source) for a hub repository id column."""
    repo = F.col(repo_col) if isinstance(repo_col, str) else repo_col
    return F.replace(repo, F.lit("/"), F.lit("_")), F.concat(F.lit(HUB_PREFIX), repo)


# ---------------------------------------------------------------- misc views
def preview(df: DataFrame, order_cols: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order (``TakeOrderedAndProject``, no full sort)."""
    return df.orderBy(*order_cols).limit(n)


# Fixed value: the training log line written by the reference's runner is
#   "Epoch {epoch:.2f} | Step {step}/{total} | Loss: {loss:.4f}"
TRAIN_LOG_PATTERN = r"^[^|]*\|\s*Step\s*(\d+)\s*/\s*(\d+)\s*\|\s*Loss:\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*$"


def parse_train_log(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(step, total, loss) from log lines; lines without that shape are skipped."""
    v = F.col(value_col)
    ok = v.contains("Step") & v.contains("Loss:") & v.rlike(TRAIN_LOG_PATTERN)
    return lines.filter(ok).select(
        F.regexp_extract(v, TRAIN_LOG_PATTERN, 1).cast("long").alias("step"),
        F.regexp_extract(v, TRAIN_LOG_PATTERN, 2).cast("long").alias("total_steps"),
        F.regexp_extract(v, TRAIN_LOG_PATTERN, 3).cast("double").alias("loss"))


def load_history(spark: SparkSession, path: str, schema: StructType | str, run_pattern: str | None = None,
                 multi_line: bool = True, packed: bool = False) -> DataFrame:
    """Metric-history JSON arrays of many runs; the run id comes from the file path.

    ``packed`` reads documents stored by ``write_json_arrays(pack=...)``: rows ``path``, ``content`` instead of a file each, with
    the same rows for a document (none for an empty array, one of nulls for a malformed one).
    """
    if packed:
        element = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        docs = spark.read.schema("path string, content string").parquet(path)
        parsed = F.coalesce(F.from_json("content", ArrayType(element), JSON_TIME_OPTIONS), F.array(F.lit(None).cast(element)))
        run = [F.url_decode(F.regexp_extract("path", run_pattern, 1)).alias("run_id")] if run_pattern else []
        return docs.select(F.inline(parsed), *run)
    r = spark.read.options(**JSON_TIME_OPTIONS).schema(schema).option("multiLine", multi_line)
    df = r.json(path)
    if run_pattern:
        df = df.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1))
    return df


def eval_split_choice(splits: DataFrame, dataset_col: str = "dataset_id") -> DataFrame:
    """Validation if present, else train, else nothing to evaluate (error row)."""
    prio = F.when(F.col("split") == "validation", 0).when(F.col("split") == "train", 1)
    best = splits.withColumn("_p", prio).groupBy(dataset_col).agg(F.min_by("split", F.col("_p")).alias("_s"),
                                                                  F.min("_p").alias("_bp"))
    return best.select(dataset_col, F.when(F.col("_bp").isNotNull(), F.col("_s")).alias("eval_split"),
                       F.when(F.col("_bp").isNull(), F.lit("no validation or train split")).alias("error"))
