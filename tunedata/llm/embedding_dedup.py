"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label link when their cosine is at least ``cosine``: unit vectors at most ``epsilon = sqrt(2 - 2 cosine)`` apart.

1. Equal vectors of a label are one class (counted before the shuffle); only classes are compared.
2. An orthonormal basis of principal dimensions comes from sums over all classes (less the label's mean in a batch; dim^2
   numbers in all).  Any orthonormal basis keeps distances, and leaving dimensions out only shortens them.
3. *Epsilon grid order*: classes are sorted by (label, length, grid cells of width epsilon on the leading principal dimensions)
   with a range exchange, which splits a hot label over many tasks; runs of the order become blocks of bounded bytes.
4. *Join of sequence intervals*: the whole sequence is an interval; a pair of intervals is split into pairs of its
   ``FAN`` parts, level by level, and goes once its boxes (labels and principal coordinates) are more than epsilon
   apart.  Pairs of blocks that are left meet in a task, which goes on halving both down to ``LEAF`` vectors.  There, intervals also go when the balls around
   them are too far apart, and link as a whole when the balls are so close that every pair must link.
5. What is left is compared by matrix products in double precision; pairs within 1e-9 of the threshold again, one by one.

A pair of blocks returns counts per class and a spanning forest of its links, never the pairs: rows stay linear in the blocks' sizes.
How much can be skipped depends on the data: vectors without structure (all directions alike) leave most block pairs of a
label, and the work then grows with the square of the label's distinct vectors; memory and rows of a task don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.llm.common import fan_out, staged
from tunedata.llm.components import components

#: leading principal dimensions with grid cells; components of a block's vectors; parts of an interval; vectors of a leaf
CELLS, BLOCK, FAN_BITS, LEAF = 8, 1 << 17, 3, 64
#: longest vectors that get a basis of their own (its matrix goes to every task); others are gridded on their own first dimensions
MAX_BASIS = 1024
#: what rounding may add to a distance, and how near the threshold a product is checked again
SLACK, NEAR = 1e-6, 1e-9


# ---- vectors -----------------------------------------------------------------------------------

def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by a power of two first, so that no square overflows or vanishes)."""
    m = np.asarray(m, dtype=np.float64)
    top = np.abs(m).max(axis=1, initial=0)
    m = np.ldexp(m, -np.frexp(top)[1][:, None])
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    return float(math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _same_length(b: pa.RecordBatch, col: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a batch."""
    import pyarrow.compute as pc
    size = pc.list_value_length(b.column(col)).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, _matrix(b.column(col).take(pa.array(at)), len(at))


def _moments(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Per task the matrix of products of the unit vectors less the mean of their label in the batch: (row number, values)."""
    total = np.zeros((dim, dim))
    for b in batches:
        if not b.num_rows:
            continue
        u = unit_rows(_matrix(b.column(1), b.num_rows))
        label = b.column(0).dictionary_encode().indices.to_numpy()
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
        sums = np.add.reduceat(u[order], starts) / np.sqrt(np.diff(np.r_[starts, len(u)]))[:, None]
        total += u.T @ u - sums.T @ sums
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "x"])


def principal_basis(classes: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns (``dim`` x at most ``CELLS``): leading principal dimensions of the vectors within their labels.

    Products are added up on the cluster; the driver gets ``dim^2`` numbers.
    """
    rows = classes.where(F.size("_vec") == dim).select("_label", "_vec")
    parts = rows.mapInArrow(lambda it: _moments(it, dim), "i int, x array<double>").select("i", F.posexplode("x").alias("j", "v"))
    total = np.zeros((dim, dim))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():                      # dim^2 rows
        total[i, j] = v
    _, vectors = np.linalg.eigh((total + total.T) / 2)
    return vectors[:, ::-1][:, :CELLS].copy()


def _place(batches: Iterator[pa.RecordBatch], basis: np.ndarray, width: float) -> Iterator[pa.RecordBatch]:
    """Adds ``pos`` (leading principal coordinates of the unit vector) and ``cell`` (their grid cells)."""
    for b in batches:
        pos = np.zeros((b.num_rows, CELLS))
        for at, m in _same_length(b, b.num_columns - 1):
            u = unit_rows(m)
            p = u @ basis if u.shape[1] == len(basis) else u[:, :CELLS]
            pos[at, :p.shape[1]] = p
        cells = np.floor(pos / width).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(pos.ravel()), CELLS).cast(pa.list_(pa.float64())),
                                          pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), CELLS).cast(pa.list_(pa.int32()))], [*b.schema.names, "pos", "cell"])


# ---- join inside a pair of blocks --------------------------------------------------------------

class _Side:
    """One block: unit vectors in grid order, and for every interval of the halving a box and a ball, when asked for."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, pos: np.ndarray):
        self.ids, self.copies, self.raw, self.unit, self.pos = ids, copies, vectors, unit_rows(vectors), pos
        self.known: dict[tuple[int, int], tuple] = {}

    def shape(self, a: int, b: int) -> tuple:
        if (a, b) not in self.known:
            centre = self.unit[a:b].mean(0)
            radius = math.sqrt(((self.unit[a:b] - centre) ** 2).sum(1).max())
            self.known[a, b] = self.pos[a:b].min(0), self.pos[a:b].max(0), centre, radius
        return self.known[a, b]


class _Links:
    """Link counts per class and a spanning forest of the links of two sides (one and the same for a block with itself)."""

    def __init__(self, left: _Side, right: _Side):
        self.left, self.right, self.one = left, right, left is right
        self.counts = [np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)]
        self.up = np.arange(len(left.ids) + (0 if self.one else len(right.ids)))
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def _tie(self, i: int, j: int) -> None:
        shift = 0 if self.one else len(self.left.ids)
        x, y = self._root(i), self._root(j + shift)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((int(self.left.ids[i]), int(self.right.ids[j])))

    def whole(self, a: int, b: int, c: int, d: int) -> None:
        """All pairs of [a, b) and [c, d) link."""
        own = self.one and (a, b) == (c, d)
        self.counts[0][a:b] += self.right.copies[c:d].sum() - (self.left.copies[a:b] if own else 0)
        if not own:
            self.counts[0 if self.one else 1][c:d] += self.left.copies[a:b].sum()
        for i in range(a, b):
            self._tie(i, c)
        for j in range(c, d):
            self._tie(a, j)

    def compare(self, a: int, b: int, c: int, d: int, least: float) -> None:
        own = self.one and (a, b) == (c, d)
        product = self.left.unit[a:b] @ self.right.unit[c:d].T
        hit = product >= least
        for i, j in np.argwhere(np.abs(product - least) < NEAR):
            hit[i, j] = exact_cosine(self.left.raw[a + i].astype(np.float64), self.right.raw[c + j].astype(np.float64)) >= least
        if own:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        self.counts[0][a:b] += hit @ self.right.copies[c:d]
        self.counts[0 if self.one else 1][c:d] += self.left.copies[a:b] @ hit
        for i, j in zip(*_forest(hit)):
            self._tie(a + int(i), c + int(j))


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep a leaf pair's components: few enough to tie one by one."""
    rows = np.flatnonzero(hit.any(1))
    first = hit[rows].argmax(1)
    cols = np.flatnonzero(hit.any(0))
    top = hit[:, cols].argmax(0)
    i, j = np.concatenate([rows, top]), np.concatenate([first, cols])
    return _bridge(hit, i, j)


def _bridge(hit: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds links between components that the first ones leave apart."""
    n = len(hit)
    label = np.arange(n + hit.shape[1])
    while True:
        for _ in range(len(label)):                              # smallest number over the chosen links
            low = np.minimum(label[i], label[n + j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, n + j, low)
            if (new == label).all():
                break
            label = new
        apart = hit & (label[:n][:, None] != label[n:][None])
        if not apart.any():
            return i, j
        x, y = np.nonzero(apart)
        _, pick = np.unique(label[x] * len(label) + label[n + y], return_index=True)
        i, j = np.concatenate([i, x[pick]]), np.concatenate([j, y[pick]])


def join_sides(left: _Side, right: _Side, cosine: float) -> _Links:
    """Recursive join of two sequences; ``left is right``: of a sequence with itself."""
    out = _Links(left, right)
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    stack = [(0, len(left.ids), 0, len(right.ids))]
    while stack:
        a, b, c, d = stack.pop()
        low, high, centre, radius = left.shape(a, b)
        low2, high2, centre2, radius2 = right.shape(c, d)
        gap = np.maximum(0, np.maximum(low - high2, low2 - high))
        if (gap * gap).sum() > (epsilon + SLACK) ** 2:
            continue
        far = math.sqrt(((centre - centre2) ** 2).sum())
        if far - radius - radius2 > epsilon + SLACK:
            continue
        if far + radius + radius2 < epsilon - SLACK:
            out.whole(a, b, c, d)
        elif b - a <= LEAF and d - c <= LEAF:
            out.compare(a, b, c, d, cosine)
        else:
            halves = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
            others = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
            stack.extend((*x, *y) for x in halves for y in others if not out.one or x <= y)
    return out


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, copies, pos, vector), sorted by block, to one row per block."""
    held: list[pa.RecordBatch] = []

    def row() -> list:
        t = pa.Table.from_batches(held).combine_chunks()
        m = _matrix(t.column("_vec").combine_chunks(), t.num_rows)
        return [t.column("_block")[0].as_py(), t.num_rows, t.column("_sid").to_numpy().tobytes(), t.column("_copies").to_numpy().tobytes(),
                _matrix(t.column("pos").combine_chunks(), t.num_rows).tobytes(), np.ascontiguousarray(m).tobytes()]

    def send() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], ["block", "n", "ids", "copies", "pos", "vec"])
    for b in batches:
        block = b.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if held and held[0].column(0)[0].as_py() != int(block[x]):
                yield send()
                held = []
            held.append(b.slice(int(x), int(y - x)))
    if held:
        yield send()


def _side(cells: list, kind: str) -> _Side:
    n, ids, copies, pos, vec = cells
    return _Side(np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8"), np.frombuffer(vec, kind).reshape(n, -1), np.frombuffer(pos, "<f8").reshape(n, CELLS))


def _join_pairs(batches: Iterator[pa.RecordBatch], kind: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, block, left, right) to counts (id, n) and links (id, other): one list of each per pair."""
    lists = [pa.list_(pa.int64())] * 4
    for b in batches:
        for k in range(b.num_rows):
            cell = [c[k].as_py() for c in b.columns]
            left = _side(cell[2:7], kind)
            out = join_sides(left, left if cell[0] == cell[1] else _side(cell[7:12], kind), cosine)
            ids, counts = [], []
            for side, n in zip((left,) if out.one else (left, out.right), out.counts):
                ids.append(side.ids[n > 0])
                counts.append(n[n > 0])
            u, v = (np.array(x, np.int64) for x in zip(*out.edges)) if out.edges else (np.zeros(0, np.int64),) * 2
            rows = [np.concatenate(ids), np.concatenate(counts), u, v]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(rows, lists)], ["id", "n", "u", "v"])


# ---- Spark -------------------------------------------------------------------------------------

def _apart(width: float) -> Column:
    """Whether the boxes of intervals a and b are further apart than ``width`` (or have no label in common)."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.lo{d}") - F.col(f"b.hi{d}"), F.col(f"b.lo{d}") - F.col(f"a.hi{d}")) for d in range(CELLS)]
    square = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    return (square > width * width) | (F.col("a.first") > F.col("b.last")) | (F.col("b.first") > F.col("a.last"))


def block_pairs(boxes: DataFrame, width: float) -> DataFrame:
    """(x, y), x <= y: pairs of blocks whose boxes are at most ``width`` apart, by joining sequence intervals from the top.

    ``boxes``: block (consecutive numbers from 0), first and last (label, length), lo0.. and hi0..
    """
    boxes = staged(boxes, "boxes")
    top = boxes.agg(F.max("block")).first()[0]
    levels = 0 if not top else math.ceil((int(top).bit_length()) / FAN_BITS)

    def intervals(level: int) -> DataFrame:
        """Intervals of 2^(FAN_BITS * level) blocks."""
        if level == 0:
            return boxes.withColumnRenamed("block", "no")
        ends = [f(f"{n}{d}").alias(f"{n}{d}") for d in range(CELLS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        return boxes.groupBy(F.shiftright("block", FAN_BITS * level).alias("no")).agg(F.min("first").alias("first"), F.max("last").alias("last"), *ends)
    pairs = intervals(levels).select(F.col("no").alias("x"), F.col("no").alias("y"))        # the whole sequence with itself
    for level in range(levels - 1, -1, -1):
        part = staged(intervals(level).withColumn("up", F.shiftright("no", FAN_BITS)), "intervals")
        left = pairs.join(part.alias("a"), F.col("x") == F.col("a.up")).select("y", F.struct("a.*").alias("a"))
        both = left.join(part.alias("b"), (F.col("y") == F.col("b.up")) & (F.col("a.no") <= F.col("b.no")) & ~_apart(width))
        pairs = staged(both.select(F.col("a.no").alias("x"), F.col("b.no").alias("y")), "interval-pairs")
    return pairs


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
                    cosine: float = 0.98) -> DataFrame:
    """Per input row: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable by links, itself
    included) and ``kept`` (it is the smallest).

    Rows link if their labels are equal and not null, their vectors are of one length, and the cosine in double precision is at least ``cosine``.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.  Repeated rows are rows of their
    own and link with each other.  Rows with a null id link like others, have the component's smallest id (null if it has none) and aren't
    kept.  Other columns are not looked at; an empty table gives an empty result.
    """
    width = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("_id"), label.alias("_label"), F.col(vec_col).alias("_vec"))
    kind = {"float": "<f4", "double": "<f8"}[rows.schema["_vec"].dataType.elementType.typeName()]
    good = (F.col("_label").isNotNull() & F.col("_vec").isNotNull() & F.exists("_vec", lambda x: x != 0)
            & F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # two 64-bit hashes name a class; different vectors share both with a probability of about (number of vectors)^2 / 2^129
    names = [F.when(F.coalesce(good, F.lit(False)), F.xxhash64(F.lit(k), "_label", "_vec")).alias(f"_k{k}") for k in (1, 2)]
    rows = rows.select("*", *names)
    classes = rows.where("_k1 is not null").groupBy("_k1", "_k2").agg(
        F.first("_label").alias("_label"), F.first("_vec").alias("_vec"), F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
    classes = staged(classes, "vector-classes")

    size = classes.groupBy(F.size("_vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    dim = size.n if size else 0
    basis = principal_basis(classes, dim) if 0 < dim <= MAX_BASIS else np.eye(max(dim, 1))[:, :CELLS]
    order = ["_label", "_n", "cell", "_k1", "_k2"]
    placed = classes.select("_k1", "_k2", "_label", F.size("_vec").alias("_n"), "_least", "_copies", "_vec")
    shape = T.StructType(list(placed.schema)).add("pos", T.ArrayType(T.DoubleType())).add("cell", T.ArrayType(T.IntegerType()))
    placed = placed.mapInArrow(lambda it: _place(it, basis, width), shape)
    parts = fan_out(vectors.sparkSession)
    grid = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_sid", F.monotonically_increasing_id())
    # a block ends with the label, the length, or after so many vectors of a task (by length)
    run = F.floor((F.col("_sid") % F.lit(1 << 33)) / F.greatest(F.lit(1), F.lit(BLOCK) / F.col("_n")))
    grid = staged(grid.withColumns({"_part": F.shiftright("_sid", 33), "_run": run.cast("long")}), "grid-order")

    box = [f(F.col("pos")[d]).alias(f"{n}{d}") for d in range(CELLS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    key = F.struct(F.col("_label").alias("l"), F.col("_n").alias("n"))
    boxes = grid.groupBy("_part", "_label", "_n", "_run").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.min("_sid").alias("_from"), *box)
    boxes = staged(_numbered(boxes), "blocks")
    numbered = grid.join(boxes.select("_part", "_label", "_n", "_run", "block"), ["_part", "_label", "_n", "_run"])
    rows_of = numbered.select(F.col("block").alias("_block"), "_sid", "_copies", "pos", "_vec")
    rows_of = rows_of.repartition(parts, "_block").sortWithinPartitions("_block", "_sid")
    blocks = staged(rows_of.mapInArrow(_block, "block long, n int, ids binary, copies binary, pos binary, vec binary"), "vector-blocks")

    pairs = block_pairs(boxes.drop("_part", "_label", "_n", "_run", "_from"), width)
    cells = ["n", "ids", "copies", "pos", "vec"]
    left = blocks.select(F.col("block").alias("x"), *[F.col(c).alias(f"a_{c}") for c in cells])
    right = blocks.select(F.col("block").alias("y"), *[F.col(c).alias(f"b_{c}") for c in cells])
    met = pairs.join(left, "x").join(right, "y").select("x", "y", *[f"a_{c}" for c in cells], *[f"b_{c}" for c in cells])
    found = met.mapInArrow(lambda it: _join_pairs(it, kind, cosine), "id array<long>, n array<long>, u array<long>, v array<long>")
    found = staged(found, "vector-links")

    links = found.select(F.inline(F.arrays_zip("id", "n"))).groupBy(F.col("id").alias("_sid")).agg(F.sum("n").alias("_far"))
    roots = components(found.select(F.inline(F.arrays_zip("u", "v"))))
    labels = grid.select("_sid", "_k1", "_k2", "_least", "_copies")
    joined = labels.join(roots.withColumnRenamed("u", "_sid").withColumnRenamed("v", "_root"), "_sid")
    # only classes in links have a component of several; its smallest id is a pre-aggregated minimum over them and their root
    ends = joined.select("_root", "_least").unionByName(labels.join(roots.select(F.col("v").alias("_sid")).distinct(), "_sid").select(F.col("_sid").alias("_root"), "_least"))
    least = staged(ends.groupBy("_root").agg(F.min("_least").alias("_comp")), "component-least")
    comp = joined.select("_sid", "_root").unionByName(least.select(F.col("_root").alias("_sid"), "_root")).join(least, "_root").select("_sid", "_comp")
    answer = labels.join(links, "_sid", "left").join(comp, "_sid", "left")
    answer = answer.select(F.col("_k1").alias("_a1"), F.col("_k2").alias("_a2"), (F.coalesce("_far", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
                           F.coalesce("_comp", "_least").alias("_comp"))
    answer = staged(answer, "vector-answer")
    out = rows.select("_id", "_k1", "_k2").join(answer, (F.col("_k1") == F.col("_a1")) & (F.col("_k2") == F.col("_a2")), "left")
    component = F.when(F.col("_a1").isNull(), F.col("_id")).otherwise(F.col("_comp"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def _numbered(boxes: DataFrame) -> DataFrame:
    """Consecutive numbers for blocks along the grid order: position in the task's run of blocks, after all blocks of earlier tasks."""
    from pyspark.sql import Window
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_from")) - 1
    boxes = boxes.withColumn("_own", own)
    sizes = boxes.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))                       # one row per task of the order
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return boxes.join(F.broadcast(starts), "_part").withColumn("block", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before")
