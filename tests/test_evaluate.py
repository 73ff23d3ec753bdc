"""The reference's evaluation-pipeline cases, run as Spark jobs."""

import json
import os

import pytest

from tunedata.operators import leaderboard as L
from tunedata.plans.evaluate import DatasetNotReadyError, ModelNotFoundError, evaluate, load_eval_split
from tunedata.plans.ingest import current_states, ingest_dataset

CK = "checkpoint_id string, model_name string, base_model string"


def _setup(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "d.jsonl")
    with open(raw, "w", encoding="utf-8") as f:
        for i in range(10):
            f.write(json.dumps({"instruction": f"say {i}", "input": "", "output": f"the answer is {i}"}) + "\n")
    reg = os.path.join(tmp_dir, "registry")
    meta = ingest_dataset(spark, raw, "jsonl", "d", os.path.join(tmp_dir, "processed"), reg)
    samples = load_eval_split(spark, meta["processed_path"]).selectExpr(
        "sha2(to_json(struct(instruction, input, output)), 256) AS id", "instruction", "input", "output")
    return meta, samples, current_states(spark, reg)


def test_echo_scores_bleu_one_and_board_entry(spark, tmp_dir):
    meta, samples, datasets = _setup(spark, tmp_dir)
    echo = samples.selectExpr("id", "output AS prediction")
    ck = spark.createDataFrame([("ckpt-1", "tuned", "base")], CK)
    paths = [os.path.join(tmp_dir, p) for p in ("results", "bench", "reports")]
    res = evaluate(spark, "ev1", "ckpt-1", meta["dataset_id"], "generation", samples, echo, ck, datasets, *paths)
    assert res["bleu"] == 1.0 and res["rouge_l"] == 1.0
    board = L.leaderboard(spark.read.parquet(paths[1]), ck).collect()
    assert [(r.model_id, r.metric_name, r.metric_value, r.rank) for r in board] == [("ckpt-1", "BLEU", 1.0, 1)]
    assert spark.read.json(paths[2]).filter("evaluation_id = 'ev1'").count() == samples.count()


def test_missing_model_or_dataset_raise(spark, tmp_dir):
    meta, samples, datasets = _setup(spark, tmp_dir)
    echo = samples.selectExpr("id", "output AS prediction")
    ck = spark.createDataFrame([("ckpt-1", "tuned", "base")], CK)
    paths = [os.path.join(tmp_dir, p) for p in ("r", "b", "p")]
    with pytest.raises(ModelNotFoundError):
        evaluate(spark, "e", "nope", meta["dataset_id"], "generation", samples, echo, ck, datasets, *paths)
    with pytest.raises(DatasetNotReadyError):
        evaluate(spark, "e", "ckpt-1", "unknown", "generation", samples, echo, ck, datasets, *paths)
