"""Conversation repair, embedding near-duplicates and vector codes: brute force and edge cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from tunedata.llm import conversation_repair as cr
from tunedata.llm import embedding_dedup as ed
from tunedata.llm import queries
from tunedata.llm import vector_codes as vc
from tunedata.llm.common import staged

WS = " \t\n\x0b\f\r"


# ---- 11 conversation repair
def cheapest(roles, faults, entry=0, exits=(0, 3)):
    """(cost, audit) by uniform-cost search over all prefixes."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(roles) and s in exits:
            return cost, audit
        new = (2, 2, 3, 2)[s]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new))
        if i < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new))
                if roles[i] == "uuau"[s]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, new))
                elif roles[i] == "s" and s == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1))


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_repair(damaged):
    by = defaultdict(list)
    for c, *x in damaged:
        by[c].append(x)
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), ""
        for _, role, text in turns:
            end = text.strip(WS)[-1:]
            faults += "b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "-"
            seen.add((role, text))
        roles = "".join(r[0] if r and r[0] in "sua" else "?" for _, r, _ in turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(roles[i:i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        cost, audit = cheapest(roles, faults)
        lines, i, s = [], 0, 0
        for x in audit:
            if x in "IR":
                lines.append(f"{'user' if 'uuau'[s] == 'u' else 'assistant'}:{'' if x == 'I' else turns[i][2]}")
                s = (2, 2, 3, 2)[s]
            elif x == "K":
                lines.append(f"{turns[i][1]}:{turns[i][2]}")
                s = 1 if roles[i] == "s" else (2, 2, 3, 2)[s]
            i += x != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def test_search_against_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        n = r.randint(0, 12)
        roles, faults = "".join(r.choice("suau?ua") for _ in range(n)), "".join(r.choice("bdt-----") for _ in range(n))
        assert cr.best_edits(roles, faults) == cheapest(roles, faults), (roles, faults)
    for _ in range(100):
        n = r.randint(1, 8)
        roles, faults = "".join(r.choice("suau?ua") for _ in range(n)), "".join(r.choice("bdt-----") for _ in range(n))
        table = cr.edit_table(roles, faults)
        for a in range(4):
            for b in range(4):
                if b > 1 or a <= b:
                    assert table.get((a, b)) == cheapest(roles, faults, a, (b,)), (roles, faults, a, b)


def test_bound_never_exceeds_the_cost():
    r = random.Random(6)
    for _ in range(500):
        n = r.randint(0, 8)
        roles, faults = "".join(r.choice("sua?") for _ in range(n)), "".join(r.choice("bdt---") for _ in range(n))
        bound = cr.Bounds(roles, faults, cr.DONE)
        for i in range(n + 1):
            for s in range(4):
                assert bound(i, s) <= cheapest(roles[i:], faults[i:], s)[0]


def test_joined_tables():
    r = random.Random(7)
    for _ in range(30):
        roles, faults = "".join(r.choice("suauaua?") for _ in range(12)), "".join(r.choice("bdt------") for _ in range(12))
        parts = [cr.edit_table(roles[i:i + 4], faults[i:i + 4]) for i in (0, 4, 8)]
        table = cr.joined_tables(cr.joined_tables(parts[0], parts[1]), parts[2])
        assert min(v for (a, b), v in table.items() if a == 0 and b in cr.DONE) == cheapest(roles, faults)


TURNS = "conv_id long, turn long, role string, text string, cost long, _conv string, alone string"


def conversations():
    r = random.Random(8)
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, None, "user", "No number."), (2, 4, "assistant", None), (2, 2, None, "Who?"),
            (3, 0, "", "Nobody."), (3, 1, "", "Nobody."), (None, 0, "user", "Lost."), (None, 1, "assistant", "Found"), (None, None, "system", ""),
            (4, 0, "system", "S."), (4, 0, "system", "S."), (4, 0, "user", "S."), (4, 9, "User", "Capital."), (5, 3, "user", " \t\n"),
            (6, 0, "user", "long " * 400000 + "."), (6, 1, "assistant", "x" * 2_000_000), (7, None, None, None), (9, -2**62, "user", "A."), (9, 2**62, "assistant", "B.")]
    for t in range(700):                                         # several pieces
        rows.append((8, t, r.choice(["user", "assistant"]) if r.random() < 0.15 else ("user", "assistant")[t % 2], r.choice(["same.", f"own {t}.", f"own {t}!", "", f"cut {t}"])))
    rows += [(100 + c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(60) for t in range(4)]
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    rows = conversations()
    return rows, staged(spark.createDataFrame([(*x, 0, "x", "y") for x in rows], TURNS).repartition(3), "test-turns")


def test_repair_edge_cases(turns):
    rows, table = turns
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = cr.repair_conversations(table)
    got = {r[0]: tuple(r)[1:] for r in found.conversations.collect()}
    hashes = {r[0]: r[1] for r in cr.hash_turns(found.turns).collect()}
    want = brute_repair(clean)
    assert {c: (*v, hashes.get(c, hashlib.sha256(b"").hexdigest())) for c, v in got.items()} == want
    edits = {(r.conv_id, r.edit) for r in found.turns.select("conv_id", "edit").distinct().collect()}
    assert {(8, "I"), (8, "K"), (8, "R")} <= edits and not any(e == "D" for _, e in edits)


def test_repair_query(spark, turns, tmp_dir):
    rows, table = turns
    table.write.parquet(f"{tmp_dir}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, tmp_dir).collect()}
    want = brute_repair(brute_damage(rows))
    empty = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c, *_ in rows}
    assert any(c not in want for c in got) or len(want) == len(got)


def test_repair_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF_SMALL).collect()}
    want = brute_repair(brute_damage(rows))
    assert got == {c: want.get(c, (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())) for c, *_ in rows}


def test_repair_empty(spark, tmp_dir):
    none = spark.createDataFrame([], TURNS)
    found = cr.repair_conversations(none)
    assert found.conversations.count() == 0 and found.turns.count() == 0
    none.write.parquet(f"{tmp_dir}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, tmp_dir).count() == 0


# ---- 12 embedding near-duplicates
def usable_vector(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_links(rows, cosine=0.98):
    """Per row (id, links, component, kept), by comparing all pairs."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    links = [0] * len(rows)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is None or a != b or not usable_vector(v) or not usable_vector(w) or len(v) != len(w):
                continue
            x, y = (np.array(z, np.float64) / np.abs(np.array(z, np.float64)).max() for z in (v, w))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    out = []
    for i, r in enumerate(rows):
        comp = least[find(i)]
        out.append((r[0], links[i], comp, r[0] is not None and r[0] == comp))
    return sorted(out, key=repr)


def vectors(n=240, dim=12, seed=3):
    g = np.random.default_rng(seed)
    base = g.normal(size=(40, dim))
    rows = []
    for i in range(n):
        v = base[g.integers(40)] + g.normal(size=dim) * g.choice([0, 0.05, 0.15, 0.5])
        rows.append((1000 + i, [float(x) for x in (v * g.choice([1e-30, 1, 1e30])).astype(np.float32)], int(g.integers(3))))
    nan, inf = float("nan"), float("inf")
    one = rows[0][1]
    return rows + [(1, None, 0), (2, [], 0), (3, [0.0] * dim, 0), (4, [nan] * dim, 0), (5, [inf] + one[1:], 0), (6, [None] + one[1:], 0), (7, one, None), (8, one, None),
                   (9, one, 0), (9, one, 0), (10, one, 0), (None, one, 0), (None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (11, [1.0], 2), (12, [2.0], 2), (13, [-1.0], 2),
                   (14, one + [0.0], 0), (15, [-0.0] * (dim - 1) + [1.0], 1), (16, [0.0] * (dim - 1) + [1.0], 1)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block,leaf,fan", [(1 << 17, 64, 3), (12 * 8, 4, 1)])
def test_links_against_brute_force(spark, monkeypatch, block, leaf, fan):
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "LEAF", leaf)
    monkeypatch.setattr(ed, "FAN_BITS", fan)
    rows = vectors()
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS + ", n_links int, kept string").repartition(5)
    got = sorted((tuple(r) for r in ed.near_duplicates(table).collect()), key=repr)
    want = brute_links(rows)
    assert got == want
    assert max(r[1] for r in want) >= 4 and len({r[2] for r in want}) > 20


def test_links_doubles_and_empty(spark):
    rows = [(1, [1e200, 0.0], "a"), (2, [1e-200, 0.0], "a"), (3, [1.0, 0.203], "a"), (4, [1.0, 0.2031], "b"), (5, [1.0, 0.204], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted((tuple(r) for r in ed.near_duplicates(table).collect()), key=repr) == brute_links(rows)
    assert ed.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    only = ed.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], VECTORS)).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_join_of_sides_skips_and_takes_whole_intervals():
    g = np.random.default_rng(2)
    close = np.r_[g.normal(size=(1, 6)) + 1e-4 * g.normal(size=(200, 6)), g.normal(size=(200, 6))]
    order = np.argsort(close[:, 0])
    close = close[order]

    def side():
        return ed._Side(np.arange(400), np.ones(400, np.int64), close, np.pad(ed.unit_rows(close), ((0, 0), (0, ed.CELLS - 6))))
    u = ed.unit_rows(close)
    hit = u @ u.T >= 0.98
    np.fill_diagonal(hit, False)
    one = side()
    out = ed.join_sides(one, one, 0.98)
    assert (out.counts[0] == hit.sum(1)).all()
    assert len(out.edges) < 400
    out = ed.join_sides(side(), side(), 0.98)
    assert (out.counts[0] == hit.sum(1) + 1).all() and (out.counts[1] == hit.sum(1) + 1).all()


def test_links_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in queries.op12_embedding_dedup(spark, SF_SMALL).collect()), key=repr)
    assert got == brute_links(rows)


# ---- 13 vector codes
def brute_codes(rows, entries=16, parts=8, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 4096).astype(np.int64)
    width = x.shape[1] // parts
    code, error, numbers = [""] * len(rows), np.zeros(len(rows), np.int64), []
    for p in range(parts):
        part = x[:, p * width:(p + 1) * width]
        book = part[:entries].copy()
        for again in range(rounds + 1):
            far = ((part[:, None] - book[None]) ** 2).sum(2)
            near = far.argmin(1)
            if again < rounds:
                book = np.array([part[near == e].sum(0) // (near == e).sum() if (near == e).any() else book[e] for e in range(len(book))])
        code = [c + f"{i:02x}" for c, i in zip(code, near)]
        error += far.min(1)
        numbers += book.ravel().tolist()
    label = defaultdict(int)
    for r, e in zip(rows, error.tolist()):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return sorted(((r[0], c, e, label[r[2]], digest) for r, c, e in zip(rows, code, error.tolist())), key=repr)


def code_query(spark, tmp_dir, rows, schema=VECTORS):
    spark.createDataFrame(rows, schema).repartition(4).write.mode("overwrite").parquet(f"{tmp_dir}/embeddings.parquet")
    return sorted((tuple(r) for r in queries.op13_vector_codes(spark, tmp_dir).collect()), key=repr)


def test_codes_edge_cases(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 16 * 50)
    monkeypatch.setattr(vc, "RUN", 7)
    g = np.random.default_rng(4)
    good = [(int(i), [float(v) for v in np.round(g.normal(size=16), int(g.integers(1, 5))).astype(np.float32)], [0, 1, None][i % 3]) for i in range(300)]
    good += [good[3], good[3], (3, good[7][1], 1), (None, good[9][1], None), (None, good[10][1], 0), (-5, [-0.0] * 16, 1)]
    one = good[0][1]
    bad = [(-1, None, 0), (-2, [], 0), (-3, [None] + one[1:], 0), (-4, [float("nan")] * 16, 1), (-6, [float("-inf")] + one[1:], 1), (-7, [1.0] * 7, 1), (-8, [1.0] * 8, None)]
    rows = [(*r, "x", 1) for r in good + bad]
    assert code_query(spark, tmp_dir, rows, VECTORS + ", code string, error int") == brute_codes(good)


def test_codes_few_rows_and_none(spark, tmp_dir):
    rows = [(i, [float(i * j % 7) for j in range(8)], 1) for i in range(5)]
    assert code_query(spark, f"{tmp_dir}/a", rows) == brute_codes(rows)
    assert code_query(spark, f"{tmp_dir}/b", []) == []
    assert code_query(spark, f"{tmp_dir}/c", [(1, [float("nan")] * 8, 1)]) == []


def test_trie_walk(monkeypatch):
    monkeypatch.setattr(vc, "RUN", 5)
    g = np.random.default_rng(1)
    part = g.integers(-2, 3, size=(500, 4))
    rows, counts, leaf = vc.leaves(part)
    assert (rows[leaf] == part).all() and counts.sum() == 500 and [tuple(r) for r in rows] == sorted({tuple(r) for r in part})
    book = g.integers(-3, 4, size=(16, 4))
    index, error = vc.walk(rows, book)
    far = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (error == far.min(1)).all()


def test_codes_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in queries.op13_vector_codes(spark, SF_SMALL).collect()), key=repr) == brute_codes(rows)
