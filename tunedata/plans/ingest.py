"""The dataset ingest job as Spark jobs: hash -> cache check -> load -> validate
(abort on ERROR) -> profile -> exact split -> one JSONL set per split -> READY.

Every step is a distributed DataFrame job; the driver only reads one-row
results (the report, the profile, the registry state of one dataset id) to
decide what to do next.  The registry is an append-only parquet table of
lifecycle versions; the current state is its latest version per dataset
(``latest_per_key``), so a retried or repeated ingest only appends.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.operators import catalog as R
from tunedata.operators import profile as P
from tunedata.operators import split as SP
from tunedata.operators import validate as V
from tunedata.session import scratch_dir
from tunedata.sources import files as S

REGISTRY_SCHEMA = ("dataset_id string, dataset_name string, source string, lifecycle_state string, version long, "
                   "ts timestamp, is_valid boolean, n_issues long, rows_count long, estimated_tokens long, "
                   "processed_path string")


class DatasetValidationError(ValueError):
    """Raised when the validation report of an ingested dataset has an ERROR issue."""


def dataset_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of the file bytes; several files combine their hashes (``combined_hash``)."""
    h = S.combined_hash(S.file_hashes(spark, path)).first()
    if h["n"] == 0:
        raise FileNotFoundError(path)
    return h["one"] if h["n"] == 1 else h["h"]


def current_states(spark: SparkSession, registry_path: str) -> DataFrame:
    """Latest registry version per dataset."""
    if not S.path_exists(spark, registry_path):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    reg = spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path)
    return R.latest_per_key(reg, ["dataset_id"], ["version"])


def ingest_dataset(spark: SparkSession, path: str, ext: str, dataset_name: str, out_root: str,
                   registry_path: str, ratios=(0.8, 0.1, 0.1), seed: int = 42,
                   source: str = "local_upload") -> dict:
    """Ingest one dataset file (or folder); returns its final registry row as a dict."""
    SP.check_ratios(*ratios)
    dataset_id = dataset_hash(spark, path)
    known = current_states(spark, registry_path).filter(F.col("dataset_id") == dataset_id).first()
    if known is not None and known["lifecycle_state"] == R.READY:          # S7 cache hit
        return known.asDict()

    version = [0 if known is None else int(known["version"]) + 1]
    row = {"dataset_id": dataset_id, "dataset_name": dataset_name, "source": source, "is_valid": None,
           "n_issues": None, "rows_count": None, "estimated_tokens": None, "processed_path": None}

    def log(state: str, **kw) -> None:
        row.update(kw, lifecycle_state=state, version=version[0], ts=dt.datetime.now(dt.timezone.utc))
        spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(registry_path)
        version[0] += 1

    log("uploaded")
    try:
        records = S.load_dataset(spark, path, ext)
        if records.columns:                               # parsed once; the steps below read the parsed rows
            parsed = scratch_dir(spark, "ingest")
            records.write.parquet(parsed)
            records = spark.read.schema(records.schema).parquet(parsed)
    except Exception:
        if S.detect_format(ext) == "jsonl":
            S.check_jsonl(spark, path)                    # names the file and line that failed
        raise
    report = V.validation_report(records).first()
    log("validated", is_valid=bool(report["is_valid"]), n_issues=int(report["n_issues"]))
    if not report["is_valid"]:                                               # V10 gate
        raise DatasetValidationError(f"dataset {dataset_name} failed validation")

    prof = P.profile(records).first()
    log("profiled", rows_count=int(prof["rows_count"]), estimated_tokens=int(prof["estimated_tokens"]))

    split = SP.split_records(records, *ratios, seed=seed)
    out = f"{out_root.rstrip('/')}/{dataset_id}"
    S.write_jsonl(split, out, partition_by=["split"])
    n = int(prof["rows_count"])
    train = int(round(ratios[0] * n))
    val = min(n - train, int(round(ratios[1] * n)))
    sizes = {"train": train, "validation": val, "test": n - train - val}
    for name, size in sizes.items():                       # an empty split is still a (empty) set
        if size == 0:
            spark.createDataFrame([], records.schema).write.mode("overwrite").json(f"{out}/split={name}")
    log("split", processed_path=out)
    log("registered")
    log("ready")
    return dict(row)
