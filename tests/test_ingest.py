"""The reference's ingest-pipeline cases, run as Spark jobs."""

import json
import os

import pytest

from tunedata.plans.ingest import DatasetValidationError, current_states, ingest_dataset


def _write(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f)
    return path


def test_clean_dataset_becomes_ready(spark, tmp_dir):
    raw = _write(os.path.join(tmp_dir, "clean.json"), [
        {"instruction": "What is gravity?", "input": "", "output": "Gravity attracts things."},
        {"instruction": "Translate hello", "input": "", "output": "Hola"},
        {"instruction": "Multiply numbers", "input": "2*3", "output": "6"}])
    reg, out = os.path.join(tmp_dir, "registry"), os.path.join(tmp_dir, "processed")
    meta = ingest_dataset(spark, raw, ".json", "test_clean_dataset", out, reg, ratios=(0.6, 0.2, 0.2))
    assert meta["lifecycle_state"] == "ready" and meta["rows_count"] == 3 and meta["estimated_tokens"] > 0
    for split in ("train", "validation", "test"):
        assert os.path.isdir(os.path.join(meta["processed_path"], f"split={split}"))
    back = spark.read.json(meta["processed_path"])
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 2, "validation": 1}
    # same bytes again: a cache hit, nothing re-processed
    again = ingest_dataset(spark, raw, "json", "renamed", out, reg, ratios=(0.6, 0.2, 0.2))
    assert again["dataset_id"] == meta["dataset_id"] and again["dataset_name"] == "test_clean_dataset"
    states = current_states(spark, reg).collect()
    assert len(states) == 1 and states[0].lifecycle_state == "ready"


def test_malformed_dataset_stops_validated(spark, tmp_dir):
    raw = _write(os.path.join(tmp_dir, "bad.json"), [{"invalid_header_key": "some cell content"}])
    reg = os.path.join(tmp_dir, "registry")
    with pytest.raises(DatasetValidationError):
        ingest_dataset(spark, raw, ".json", "malformed_set", os.path.join(tmp_dir, "out"), reg)
    states = current_states(spark, reg).collect()
    assert len(states) == 1 and states[0].lifecycle_state == "validated"
    assert states[0].is_valid is False and states[0].n_issues > 0


def test_folder_of_files_is_one_dataset(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "parts")
    os.makedirs(folder)
    for k in range(3):
        with open(os.path.join(folder, f"part-{k}.jsonl"), "w", encoding="utf-8") as f:
            for i in range(4):
                f.write(json.dumps({"instruction": f"q{k}-{i}", "output": f"a{k}-{i}"}) + "\n")
    reg = os.path.join(tmp_dir, "registry")
    meta = ingest_dataset(spark, folder, "jsonl", "parts", os.path.join(tmp_dir, "out"), reg)
    assert meta["lifecycle_state"] == "ready" and meta["rows_count"] == 12
    back = spark.read.json(meta["processed_path"])
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == \
        {"train": 10, "validation": 1, "test": 1}
