"""The training-data preparation job on a hand-made CSV."""

import json
import os

import pytest

from tunedata.plans.prepare import prepare_training_data


def test_prepare_writes_chat_splits_once(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw.csv")
    with open(raw, "w", encoding="utf-8") as f:
        f.write("prompt,context,answer\n")
        for i in range(9):
            f.write(f"\"  q{i} \",ctx{i % 2},a{i}\n")
        f.write('" q0",ctx0,a0\n')          # a duplicate after stripping
        f.write('" q0",ctx0,a0\n')          # and an identical raw row
        f.write("qx,NA,NA\n")               # dropped: output is NA -> null
    cols = {"instruction": "prompt", "input": "context", "output": "answer"}
    tr, va = os.path.join(tmp_dir, "train"), os.path.join(tmp_dir, "val")
    funnel = prepare_training_data(spark, raw, tr, va, columns=cols, test_size=0.2)
    assert funnel == {"initial_rows": 12, "null_free_rows": 11, "duplicates_removed": 2, "final_rows": 9,
                      "train_rows": 7, "validation_rows": 2}
    rows = [json.loads(line) for d in (tr, va) for fn in sorted(os.listdir(d)) if fn.endswith(".json")
            for line in open(os.path.join(d, fn), encoding="utf-8")]
    assert len(rows) == 9
    user = {r["messages"][1]["content"] for r in rows}
    assert "q1\n\nContext:\nctx1" in user and all(r["messages"][0]["role"] == "system" for r in rows)
    assert prepare_training_data(spark, raw, tr, va, columns=cols) is None      # outputs exist: skipped


def test_prepare_requires_mapped_columns(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "bad.csv")
    with open(raw, "w", encoding="utf-8") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        prepare_training_data(spark, raw, os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "v"))


def test_first_row_by_file_name_and_line(spark, tmp_dir):
    """Of equal rows in several files the one of the first file and line stays, however large the files are."""
    kept = []
    for folder in ("x", "elsewhere"):
        raw = os.path.join(tmp_dir, folder)
        os.mkdir(raw)
        with open(os.path.join(raw, "a.csv"), "w") as f:
            f.write("instruction,input,output\nsame,,one\nonly a,,one\n")
        with open(os.path.join(raw, "b.csv"), "w") as f:
            f.write("instruction,input,output\n" + "".join(f"row {i},,two {i}\n" for i in range(500)) + "same,,one\n")
        tr, va = os.path.join(tmp_dir, folder + "-t"), os.path.join(tmp_dir, folder + "-v")
        assert prepare_training_data(spark, raw, tr, va)["duplicates_removed"] == 1
        kept.append([sorted(json.loads(line)["messages"][1]["content"] for fn in os.listdir(d) if fn.endswith(".json")
                            for line in open(os.path.join(d, fn))) for d in (tr, va)])
    assert kept[0] == kept[1] and sum(map(len, kept[0])) == 502
