"""Vector code compression: product codes whose codebooks are fitted on tries of distinct parts.

Each component becomes the integer ``floor(scale * x)``; a vector is cut into ``parts`` equal parts, and each
part position has a codebook of ``entries`` entries.  All arithmetic is on integers, so results don't depend on how
rows fall into tasks.

One pass over the vectors stores, per block of rows and part position, the distinct parts in lexicographic order with
their counts: the leaves of a trie, in depth-first order, whose edges are component values.  Every round walks
the stored tries: a node holds the squared distances of its prefix to all entries, computed once from
its parent's and shared by all leaves below.  Leaves take the nearest entry, and their components, weighted by
their counts, go to that entry's sums.  The walk is depth first over runs of ``RUN`` leaves; inside a run nodes are evaluated level by level,
and the open path (the nodes above the last leaf) is carried to the next run, so memory doesn't
depend on the size of a trie.

Rounds move nothing but sums: ``parts * entries`` rows of a part's width, whatever the number of vectors.  There is no
shuffle of vectors or parts, so no hot key; copies inside a block are one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.llm.common import staged

#: rows whose parts make one set of tries, in components (memory of a task), and leaves evaluated at once
BLOCK, RUN = 1 << 21, 1 << 13
#: integers are held to this magnitude, so that sums of squares stay exact in 64 bits
HELD = 1 << 24


@dataclass
class Codebooks:
    """``entries[p][e]``: integer components of entry e at part position p."""
    entries: np.ndarray
    scale: int

    def text(self) -> str:
        """All components by part, entry and position within the part."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -HELD, HELD).astype(np.int64)


def leaves(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, their counts, and the leaf of every row."""
    order = np.lexsort(part.T[::-1]) if part.shape[1] else np.arange(len(part))
    rows = part[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.zeros(0, bool)
    leaf = np.empty(len(part), np.int64)
    leaf[order] = np.cumsum(new) - 1
    return rows[new], np.bincount(leaf, minlength=int(new.sum())), leaf


def walk(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for sorted distinct ``rows``: the trie, depth first."""
    n, width = rows.shape
    index, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    path = [np.zeros((1, len(book)), np.int64)] * (width + 1)    # entry distances of the nodes above the last leaf
    last = None
    for a in range(0, n, RUN):
        run = rows[a:a + RUN]
        before = np.concatenate([run[:1] if last is None else last, run[:-1]])
        change = run != before
        if last is None:
            change[0] = True
        opens = np.logical_or.accumulate(change, axis=1)         # the leaf opens a new node at this depth
        above, at = path[0], np.zeros(len(run), np.int64)        # nodes of the depth above, and each leaf's among them
        for d in range(width):
            fresh = np.flatnonzero(opens[:, d])
            nodes = above[at[fresh]] + (run[fresh, d][:, None] - book[:, d]) ** 2
            at = np.cumsum(opens[:, d])                          # 0: the node of the open path
            above = np.concatenate([path[d + 1], nodes])
            path[d + 1] = above[at[-1:]]
        index[a:a + len(run)] = above.argmin(1)[at]              # the first of equal distances
        error[a:a + len(run)] = above.min(1)[at]
        last = run[-1:]
    return index, error


# ---- Spark -------------------------------------------------------------------------------------

def usable(vectors: DataFrame, vec_col: str, parts: int) -> DataFrame:
    """Rows whose vector has the table's length and only finite components.

    The length is the most frequent one among whole multiples of ``parts`` (the smaller of equally frequent ones).
    """
    whole = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(whole & (F.size(vec_col) > 0) & (F.size(vec_col) % parts == 0))
    size = good.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return good.where(F.size(vec_col) == (size.n if size else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _blocks(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows gathered to blocks of about ``BLOCK`` components, and their matrix (column ``col``)."""
    held, size = [], 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        return t, _matrix(t.column(col).combine_chunks(), t.num_rows)
    for b in batches:
        at = 0
        while at < b.num_rows:
            width = max(len(b.column(col)[at]), 1)
            take = min(b.num_rows - at, max(1, (BLOCK - size) // width))
            held.append(b.slice(at, take))
            at, size = at + take, size + take * width
            if size + width > BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _tries(batches: Iterator[pa.RecordBatch], parts: int, scale: int) -> Iterator[pa.RecordBatch]:
    for _, m in _blocks(batches, 0):
        x = integers(m, scale)
        width = x.shape[1] // parts
        cut = [leaves(x[:, p * width:(p + 1) * width]) for p in range(parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([len(r) for r, _, _ in cut], pa.int32()),
             pa.array([r.astype("<i4").tobytes() for r, _, _ in cut], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n, _ in cut], pa.binary())],
            ["part", "n", "leaves", "counts"])


def part_tries(vectors: DataFrame, vec_col: str, parts: int, scale: int) -> DataFrame:
    """(part, n, leaves, counts): per block of rows and part position the distinct parts, sorted, and how often each occurs."""
    return vectors.select(vec_col).mapInArrow(lambda it: _tries(it, parts, scale), "part int, n int, leaves binary, counts binary")


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per task one row for each part position, entry and component: weighted sum, and number of parts (component -1)."""
    parts, k, width = books.shape
    total, count = np.zeros((parts, k, width), object), np.zeros((parts, k), object)
    for b in batches:
        for i in range(b.num_rows):
            p = b.column(0)[i].as_py()
            rows = np.frombuffer(b.column(2)[i].as_py(), "<i4").astype(np.int64).reshape(b.column(1)[i].as_py(), width)
            n = np.frombuffer(b.column(3)[i].as_py(), "<i4").astype(np.int64)
            index, _ = walk(rows, books[p])
            for e in np.unique(index):
                at = index == e
                total[p, e] += (rows[at] * n[at][:, None]).sum(0)
                count[p, e] += int(n[at].sum())
    flat = np.concatenate([count[:, :, None], total], axis=2)
    p, e, j = (x.ravel() for x in np.indices(flat.shape))
    used = np.repeat(count.ravel() > 0, width + 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(p[used], pa.int32()), pa.array(e[used], pa.int32()), pa.array(j[used] - 1, pa.int32()),
         pa.array([Decimal(int(x)) for x in flat.ravel()[used]], pa.decimal128(38, 0))], ["part", "entry", "j", "s"])


def fit_codebooks(vectors: DataFrame, id_col: str, vec_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of the whole table (``usable`` rows); None if it has none.

    A codebook starts as that part of the ``entries`` smallest ids (nulls last; equal ids by vector).  Each round replaces
    an entry by the componentwise ``floor(sum / count)`` of the parts nearest to it (ties: lower index); an entry
    without parts stays.  The driver holds the codebooks only.
    """
    first = vectors.select(id_col, vec_col).orderBy(F.col(id_col).asc_nulls_last(), vec_col).limit(entries).collect()
    if not first:
        return None
    start = integers(np.array([r[1] for r in first], dtype=np.float64), scale)
    books = np.stack(np.split(start, parts, axis=1))
    tries = staged(part_tries(vectors, vec_col, parts, scale), "part-tries")
    for _ in range(rounds):
        now = books
        found = tries.mapInArrow(lambda it: _sums(it, now), "part int, entry int, j int, s decimal(38,0)")
        sums = found.groupBy("part", "entry", "j").agg(F.sum("s").alias("s")).collect()      # parts * entries * (width + 1) rows at most
        value = {(r.part, r.entry, r.j): int(r.s) for r in sums}
        books = books.copy()
        for (p, e, j), s in value.items():
            if j >= 0:
                books[p, e, j] = s // value[p, e, -1]
    return Codebooks(books, scale)


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int, keep: int) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for t, m in _blocks(batches, keep):
        x = integers(m, scale)
        code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            rows, _, leaf = leaves(x[:, p * width:(p + 1) * width])
            index, far = walk(rows, books[p])
            code[:, p] = index[leaf]
            error += far[leaf]
        out = t.drop_columns([t.column_names[keep]]).append_column("code", pa.array([r.tobytes() for r in code], pa.binary())).append_column("error", pa.array(error))
        yield from out.to_batches()


def encode_vectors(vectors: DataFrame, vec_col: str, books: Codebooks) -> DataFrame:
    """Every row without its vector, with ``code`` (binary, one index a part) and ``error`` (squared distance over all parts)."""
    others = [c for c in vectors.columns if c != vec_col]
    schema = T.StructType([vectors.schema[c] for c in others] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return vectors.select(*others, vec_col).mapInArrow(lambda it: _encode(it, books.entries, books.scale, len(others)), schema)


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8,
                     entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, ``code``, ``error``, ``label_error``) of every usable row, and the codebooks.

    ``label_error`` adds up ``error`` over rows of equal label (nulls together).  Rows are dropped whose vector is null or empty, holds
    null or non-finite components, or has another length than the table's (see ``usable``).  Components beyond
    2^24 / ``scale`` in magnitude count as that.  Rows with a null id or label and repeated rows are rows like others; with
    fewer rows than ``entries`` the codebooks are shorter; an empty table gives an empty result and no codebooks.  Other columns are not
    looked at, whatever their names.  ``entries`` is at most 256.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_vec"))
    rows = usable(rows, "_vec", parts)
    books = fit_codebooks(rows, "_id", "_vec", parts, entries, rounds, scale)
    if books is None:
        coded = rows.select("_id", "_label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
    else:
        coded = encode_vectors(rows, "_vec", books)
    coded = staged(coded, "vector-codes")
    sums = coded.groupBy(F.col("_label").alias("_l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_l")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error"), books
