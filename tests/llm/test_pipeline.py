"""The pipeline against brute force, stage by stage, on the smallest table."""

import re
from collections import Counter

import corpus_pipeline
from conftest import SF_SMALL
from test_operators import brute_features, lower, word_set
from tunedata.llm.common import staged


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_join", "mixing", "packing"]
    seen, rows = [], {}
    for _, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = staged(stage(spark, docs, SF_SMALL), "t")
        if len(seen) < 4:
            assert out.columns == docs.columns
        seen.append((rows, docs, out))
        docs = out
    rows, _, out = seen[0]
    passed = {i for i, t in rows.items() for f in [brute_features(t)] if f[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    assert {r.doc_id for r in out.collect()} == passed
    rows, _, out = seen[1]
    assert {r.doc_id for r in out.collect()} == set({lower(t): i for i, t in sorted(rows.items())}.values())
    rows, _, out = seen[2]
    up = {i: i for i in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = {i: word_set(t) for i, t in rows.items()}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id for r in out.collect()} == {find(i) for i in rows}
    rows, _, out = seen[3]
    copies = Counter(r.doc_id for r in out.collect())
    assert set(copies) <= set(rows) and max(copies.values()) <= 2
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows.items()}
    assert abs(sum(words[i] * n for i, n in copies.items()) / sum(words.values()) - 1.5) < 0.1
    out = seen[4][2]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(copies)


def test_no_row_is_lost_and_any_row_is_taken(spark):
    """Repeated and null ids, null columns, empty and very long texts, columns that clash, and an empty table."""
    own = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(9)]
    near = own[1] + " one more"
    rows = [(1, own[0], "a"), (2, own[0] + "!", "a"), (2, own[1], "a"), (3, near, "b"), (5, own[2], None), (None, own[3], "b"), (None, own[4], "b"), (None, own[4] + " end", "b"),
            (6, None, "b"), (7, "", "b"), (8, " \n" * 600_000, "c"), (9, own[5] + " " * 1_000_000 + own[6], "c"), (10, own[7], "c"), (10, own[7], "c"), (11, own[8] + " x" * 3, "a")]
    schema = "doc_id long, text string, source string, _row int, n int, kept string"
    docs = staged(spark.createDataFrame([(*r, 5, 6, "x") for r in rows], schema).repartition(3), "t")
    kept = corpus_pipeline.near(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter((i, t) for i, t, _ in rows) - Counter([(2, own[0] + "!"), (3, near), (10, own[7])])
    lost = want - got
    assert not got - want and set(lost) <= {(None, own[4]), (None, own[4] + " end")} and sum(lost.values()) == 1
    for table in (docs, docs.where("false")):
        before = table
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, before, SF_SMALL), "t")
            if name != "packing":
                assert out.columns == docs.columns and (name == "mixing" or out.exceptAll(before).isEmpty())
                before = out
        tokens = out.groupBy("doc_id", "doc_tokens").count().count()
        assert (tokens > 0) == (table is docs)
