"""The training-data preparation job as Spark jobs: skip if the outputs exist ->
read CSV (NA tokens -> null) -> map and check columns -> clean and de-duplicate -> two-way seeded
split -> chat JSONL per split -> schema audit of what was written; returns the cleaning funnel."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tunedata.operators import chat as H
from tunedata.operators import clean as C
from tunedata.operators import split as SP
from tunedata.operators import validate as V
from tunedata.session import scratch_dir
from tunedata.sources import files as S


def audit_chat_jsonl(spark: SparkSession, path: str) -> None:
    """V7 with ``fail_fast``: read the written lines as text and raise on the first violation, by file and line."""
    V.assert_chat_schema(V.chat_file_violations(spark, path), "file", "line")


def prepare_training_data(spark: SparkSession, raw_csv: str, train_path: str, val_path: str,
                          columns: dict[str, str] | None = None, test_size: float = 0.2, seed: int = 42,
                          system_prompt: str = H.DEFAULT_SYSTEM_PROMPT) -> dict | None:
    """Returns the cleaning funnel, or None when both outputs already exist."""
    if S.path_exists(spark, train_path) and S.path_exists(spark, val_path):
        return None
    scratch = scratch_dir(spark, "prepare")
    scan = S.placed(S.read_csv(spark, raw_csv))
    columns_only = [c for c in scan.columns if c not in S.PLACE]
    mapped = C.map_columns(S.apply_na(scan, cols=columns_only), columns)    # C1 + V8 (raises on missing columns)
    # parsed once; a row is named by its file and its number in it, so "first" (C5) and the split depend neither on how the
    # scan was cut nor on where the files lie
    rows = S.row_numbers(mapped.select(*S.PLACE, "instruction", "input", "output"), scan)
    name = F.concat_ws(":", F.element_at(F.split("_file", "/"), -1), F.lpad(F.col("line").cast("string"), 20, "0"))
    rows.select(name.alias("id"), "instruction", "input", "output").write.parquet(f"{scratch}/parsed")
    keyed = spark.read.parquet(f"{scratch}/parsed")
    split = SP.two_way_split(C.clean_instructions(keyed), "id", test_size=test_size, seed=seed)
    H.chat_messages(split, system_prompt).select("split", "messages").write.partitionBy("split").parquet(f"{scratch}/chat")
    chat = spark.read.schema("messages array<struct<role string, content string>>, split string").parquet(f"{scratch}/chat")
    for name, path in (("train", train_path), ("validation", val_path)):
        # both outputs are (re)written together; the skip above is the idempotency check
        S.write_jsonl(chat.filter(F.col("split") == name).select("messages"), path, mode="overwrite")
        audit_chat_jsonl(spark, path)
    return C.cleaning_funnel(keyed, test_size=test_size).first().asDict()


