"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

Sets are the distinct word shingles of whole texts; equal sets are one class, so copies cost
one row each.  All orders below are: rare shingles first (by document frequency where it is among
the ``max_frequent`` highest, counted over all documents), then by hash.  Two sets with Jaccard
similarity ``pct`` % share at least l elements among the first ``n - ceil(pct n / 100) + l`` of each.

* Small sets (up to a boundary) enumerate the two-element subsets of that prefix with l = 2:
  similar small sets share a subset.
* Large sets, and the small ones close enough in size to be similar to a large one, enter
  inverted lists of the single elements of the prefix with l = 1.
* The boundary makes the number of entries plus the expected list scans least; it uses the
  size histogram and the mean list length, both counted over all documents.

Lists and subsets are one index (key, class, size, position).  Candidates come from its keys, never as all
pairs of a key: first every member against one hub of its key (linear in the index), verified,
then components; then another hub for those still apart; at last only members of
different components.  Pairs must pass the size filter and the position filter (from
the position of the shared element, the overlap left is bounded), so no pair that links is lost:
links inside one component are not needed for the components.  Every candidate is verified on
the whole shingle sets.

Hashes have 64 bits: sets are compared by shingle hashes, and two different sets are taken for one class
with a probability of about (number of classes)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.llm.common import fan_out, staged
from tunedata.llm.components import components
from tunedata.llm.shingles import mix, shingle_sets

#: rows shingled at once, and shingles or index entries held before they are sent on
ROWS, HELD = 256, 1 << 20
#: index entries at the boundary are counted for set sizes up to this
MAX_SMALL = 64
ENTRY = np.dtype([("k", "<u4"), ("c", "<i8"), ("n", "<u4"), ("p", "<u4")])
#: bitmap of wanted rows: bits for each of them, and its size as a power of two at least and at most (16 MB)
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 24, 27


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(part of a batch, bounds, hashes); the last column is the text."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, *shingle_sets(part.column(part.num_columns - 1), k)


def _classes(bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit number per set, equal for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part, bounds, h in _sets(batches, k):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(_classes(bounds, h))], ["_id", "n", "cls"])


def set_table(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(``_id``, ``n`` shingles, ``cls``) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(lambda it: _describe(it, k), f"_id {rows.schema['_id'].dataType.simpleString()}, n long, cls long")


# ---- document frequencies ---------------------------------------------------------------------

def _short(h: np.ndarray, parts: int) -> np.ndarray:
    """Bucket and upper half of a hash as one number: the name of a shingle in the order."""
    return ((h % np.uint64(parts)) << np.uint64(32)) | (h >> np.uint64(32))


def _by_bucket(names: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Bytes per bucket (high half of ``names``, which are sorted)."""
    bucket = (names >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(at, np.r_[at[1:], len(bucket)]):
        yield int(bucket[a]), [x[a:b].tobytes() for x in arrays]


def _count_part(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def send() -> pa.RecordBatch:
        names, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        rows = [(b, *x) for b, x in _by_bucket(names, [names.astype("<u4"), n.astype("<u4")])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "names", "counts"])
    for _, _, h in _sets(batches, k):
        held.append(_short(h, parts))
        if sum(map(len, held)) >= HELD:
            yield send()
    if sum(map(len, held)):
        yield send()


def _count_all(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One bucket: frequent shingles, and one row (name -1) with the sums of df and df^2 of the others."""
    names, counts, bucket = [], [], 0
    for b in batches:
        for i in range(b.num_rows):
            bucket = b.column(0)[i].as_py()
            names.append(np.frombuffer(b.column(1)[i].as_py(), "<u4"))
            counts.append(np.frombuffer(b.column(2)[i].as_py(), "<u4"))
    if not names:
        return
    u, at = np.unique(np.concatenate(names), return_inverse=True)
    df = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    some = df >= least
    rest = df[~some]
    name = np.r_[(np.int64(bucket) << 32) | u[some].astype(np.int64), -1, -2]
    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.r_[df[some], rest.sum(), (rest * rest).sum()])], ["name", "df"])


def shingle_counts(docs: DataFrame, text_col: str, k: int, parts: int, least: int = 8) -> DataFrame:
    """(name, df) of shingles in at least ``least`` documents; names -1 and -2 hold sums over the others.

    Every task sends its counts (already summed over its own documents) as one array per hash bucket.
    """
    part = docs.select(F.col(text_col).alias("_text")).mapInArrow(lambda it: _count_part(it, k, parts), "bucket int, names binary, counts binary")
    return part.repartitionById(parts, F.col("bucket")).mapInArrow(lambda it: _count_all(it, least), "name long, df long")


def frequent(counts: DataFrame, max_frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``max_frequent`` most frequent shingles at most (whole powers of two of df): sorted names, and their df."""
    power = F.floor(F.log2(F.col("df").cast("double"))).cast("int")
    sizes = sorted((r[0], r[1]) for r in counts.where("name >= 0").groupBy(power.alias("p")).count().collect())    # at most 64 rows
    cut, held = 64, 0
    for p, n in reversed(sizes):
        if held + n > max_frequent:
            break
        cut, held = p, held + n
    rows = counts.where((F.col("name") >= 0) & (power >= cut)).toArrow()
    names, df = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(names)
    return names[order].astype(np.uint64), df[order].astype(np.int64)


# ---- index -------------------------------------------------------------------------------------

def prefix_length(n, pct: int, share: int = 1):
    """Elements of which two similar sets share at least ``share``."""
    return n - (pct * n + 99) // 100 + share


def boundary(sizes: dict[int, int], scan: float, pct: int) -> int:
    """Largest size of a small set: least number of index entries and expected list scans.

    ``sizes``: sets by size (large sizes may be left out: they cost the same for each
    boundary); ``scan``: entries met when a list is read through.
    """
    def cost(x: int) -> float:
        pairs = sum(c * prefix_length(n, pct, 2) * (prefix_length(n, pct, 2) - 1) / 2 for n, c in sizes.items() if 2 <= n <= x)
        near = -(-pct * (x + 1) // 100)
        return pairs + sum(c * prefix_length(n, pct) * (1 + scan) for n, c in sizes.items() if n >= near)
    return min(range(1, MAX_SMALL + 1), key=lambda x: (cost(x), x))


def _index_part(batches: Iterator[pa.RecordBatch], k: int, parts: int, names: np.ndarray, df: np.ndarray, small: int, pct: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    near = -(-pct * (small + 1) // 100)

    def entries(bounds, h):
        n = np.diff(bounds)
        cls = _classes(bounds, h)
        row = np.repeat(np.arange(len(n)), n)
        rank = np.zeros(len(h), np.int64)
        if len(names) and len(h):
            name = _short(h, parts)
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            rank = np.where(names[at] == name, df[at], 0)
        h = h[np.lexsort((rank, row))]                           # stable: by hash within a rank
        pos = np.arange(len(h)) - bounds[row]
        take = (pos < prefix_length(n, pct)[row]) & (n[row] >= near)
        yield h[take], cls[row[take]], n[row[take]], pos[take]
        for size in range(2, small + 1):                         # two-element subsets
            rows = np.flatnonzero(n == size)
            if len(rows):
                p = prefix_length(size, pct, 2)
                i, j = np.triu_indices(p, 1)
                first = h[bounds[rows][:, None] + np.arange(p)]
                key = mix(first[:, i] * np.uint64(0x9FB21C651E98DF25) + first[:, j]).ravel()
                yield key, np.repeat(cls[rows], len(i)), np.full(len(key), size), np.zeros(len(key), np.int64)

    def send() -> pa.RecordBatch:
        key, cls, n, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        name = _short(key, parts)
        order = np.lexsort((cls, name))
        name, cls, n, pos = name[order], cls[order], n[order], pos[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (cls[1:] != cls[:-1])] if len(name) else np.zeros(0, bool)      # copies
        out = np.zeros(int(new.sum()), ENTRY)
        out["k"], out["c"], out["n"], out["p"] = name[new], cls[new], n[new], pos[new]
        rows = [(b, *x) for b, x in _by_bucket(name[new], [out])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])
    for _, bounds, h in _sets(batches, k):
        held.extend(entries(bounds, h))
        if sum(len(x[0]) for x in held) >= HELD // 2:
            yield send()
    if sum(len(x[0]) for x in held):
        yield send()


def _index_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: entries of the keys that two or more classes have."""
    blobs, bucket = [], 0
    for b in batches:
        for i in range(b.num_rows):
            bucket = b.column(0)[i].as_py()
            blobs.append(np.frombuffer(b.column(1)[i].as_py(), ENTRY))
    if not blobs:
        return
    e = np.concatenate(blobs)
    e = e[np.lexsort((e["c"], e["k"]))]
    e = e[np.r_[True, (e["k"][1:] != e["k"][:-1]) | (e["c"][1:] != e["c"][:-1])]]
    same = e["k"][1:] == e["k"][:-1]
    e = e[np.r_[same, False] | np.r_[False, same]]
    for i in range(0, len(e), 1 << 16):
        x = e[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array((np.int64(bucket) << 32) | x["k"].astype(np.int64)), pa.array(x["c"].astype(np.int64)),
                                          pa.array(x["n"].astype(np.int64)), pa.array(x["p"].astype(np.int64))], ["key", "cls", "n", "pos"])


def inverted_index(docs: DataFrame, text_col: str, k: int, parts: int, names: np.ndarray, df: np.ndarray, small: int, pct: int) -> DataFrame:
    """(key, cls, n, pos) of the keys of two or more classes."""
    part = docs.select(F.col(text_col).alias("_text")).mapInArrow(
        lambda it: _index_part(it, k, parts, names, df, small, pct), "bucket int, entries binary")
    return part.repartitionById(parts, F.col("bucket")).mapInArrow(_index_all, "key long, cls long, n long, pos long")


# ---- candidates and verification ---------------------------------------------------------------

def _may_link(pct: int) -> Column:
    """Size filter, and overlap still possible from the positions of the shared element (a and b)."""
    na, nb = F.col("a.n"), F.col("b.n")
    need = F.ceil(F.lit(pct) * (na + nb) / (100 + pct))
    return ((100 * F.least(na, nb) >= pct * F.greatest(na, nb))
            & (1 + F.least(na - F.col("a.pos") - 1, nb - F.col("b.pos") - 1) >= need))


def _pairs(a: DataFrame, b: DataFrame, differ: Column, pct: int) -> DataFrame:
    return (a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & differ).where(_may_link(pct))
            .select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")).distinct())


def _labelled(index: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Index with the component of each class; keys of one component only are done and left out."""
    if roots is None:
        return index.withColumn("comp", F.col("cls"))
    out = index.join(roots.withColumnRenamed("u", "cls"), "cls", "left").withColumn("comp", F.coalesce("v", "cls")).drop("v")
    open_keys = out.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("key")
    return staged(out.join(open_keys, "key", "left_semi"), "join-index")


def bitmap_bits(wanted: int) -> int:
    """Size of the bitmap for so many wanted rows (power of two)."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ROW * wanted).bit_length()))


def _fetch(batches: Iterator[pa.RecordBatch], k: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    mask = 64 * len(wanted) - 1
    for part, bounds, h in _sets(batches, k):
        cls, row = _classes(bounds, h), part.column(0).to_numpy()
        slot = (cls ^ row) & mask
        hit = np.flatnonzero((wanted[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(row[hit]), pa.array([h[bounds[i]:bounds[i + 1]].tobytes() for i in hit], pa.binary())],
                                             ["cls", "row", "shingles"])


def fetch_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the wanted (cls, rep): one more pass over the texts instead of a shuffle of them.

    A bitmap of the wanted rows goes to the tasks; rows that pass it by chance (1 in 16 at most) leave in the
    join.  Its size follows the number of wanted rows up to ``MOST_BITS``; with many more rows than that
    it lets most through, and the join alone decides.  The shuffle that drops repeated rows is the one that both
    sides of the verification read, so the texts are shingled once.
    """
    wanted = staged(wanted.select("cls", F.xxhash64("rep").alias("row")), "join-wanted")
    bits = bitmap_bits(wanted.count())
    slot = F.col("cls").bitwiseXOR(F.col("row")).bitwiseAND((1 << bits) - 1)
    words = (wanted.select(slot.alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow())      # at most 2^21 rows
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    rows = docs.select(F.xxhash64(id_col).alias("row"), F.col(text_col).alias("_text"))
    found = rows.mapInArrow(lambda it: _fetch(it, k, bitmap), "cls long, row long, shingles binary")
    found = found.join(wanted, ["cls", "row"], "left_semi")
    return found.dropDuplicates(["cls"]).select("cls", "shingles")


@F.pandas_udf(T.LongType())
def _overlap(a, b):
    import pandas as pd
    return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (u, v) whose Jaccard similarity is at least ``pct`` %, from the whole sets."""
    both = (pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
            .select("u", "v", (F.octet_length("su") / 8 + F.octet_length("sv") / 8).cast("long").alias("n"), _overlap("su", "sv").alias("o")))
    return both.where(100 * F.col("o") >= pct * (F.col("n") - F.col("o"))).select("u", "v")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 75,
                       max_frequent: int = 1 << 20, hub_rounds: int = 2) -> DataFrame:
    """Per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, itself included).

    Two rows link when ``100 * |A n B| >= pct * |A u B|`` for their sets of ``k``-word shingles (whole texts, words
    split at ASCII white space, A-Z lower-cased).  A text of fewer words is one shingle; a null text, or
    one without words, has the empty set, links with nothing and is its own component.  Repeated rows
    have a result each.  Rows with a null id join the component of their text if some row with an id has
    the same set, else their ``component_id`` is null; a text that only null ids have makes no
    links.  Other columns are not looked at.  An empty table gives an empty result.  ``docs`` should be a stored
    table (it is read several times).
    """
    spark = docs.sparkSession
    parts = fan_out(spark)
    sets = staged(set_table(docs, id_col, text_col, k), "join-sets")
    classes = sets.where("n > 0").groupBy("cls").agg(F.min("_id").alias("rep"), F.max("n").alias("n"))
    classes = staged(classes.where(F.col("rep").isNotNull()), "join-classes")

    counts = staged(shingle_counts(docs, text_col, k, parts), "join-counts")
    names, df = frequent(counts, max_frequent)
    rest = {r[0]: r[1] for r in counts.where("name < 0").groupBy("name").agg(F.sum("df")).collect()}
    scan = rest.get(-2, 0) / max(rest.get(-1, 0), 1)
    sizes = {r[0]: r[1] for r in classes.where(F.col("n") <= 2 * MAX_SMALL).groupBy("n").count().collect()}       # at most 128 rows
    small = boundary(sizes, scan, pct)
    index = inverted_index(docs, text_col, k, parts, names, df, small, pct).join(classes.select("cls"), "cls", "left_semi")
    index = staged(index, "join-entries")
    index = staged(index.join(index.groupBy("cls").agg(F.count(F.lit(1)).alias("deg")), "cls"), "join-index")

    tested = roots = None
    for step in range(hub_rounds + 1):
        members = _labelled(index, roots)
        if step < hub_rounds:
            # first the class that shares most keys: edits bring rare shingles of their own, an original has few
            order = -F.col("deg") if step == 0 else F.xxhash64(F.lit(step), "cls")
            pick = F.struct(order.alias("_o"), "cls", "n", "pos", "comp")
            hubs = members.groupBy("key").agg(F.min(pick).alias("_h")).select("key", "_h.cls", "_h.n", "_h.pos", "_h.comp")
            pairs = _pairs(hubs, members, F.col("a.comp") != F.col("b.comp"), pct)
        else:
            pairs = _pairs(members, members, F.col("a.comp") < F.col("b.comp"), pct)
        pairs = staged(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "join-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        wanted = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct().join(classes, "cls")
        found = staged(verified(pairs, fetch_sets(docs, id_col, text_col, k, wanted), pct), "join-links")
        if not found.isEmpty() or roots is None:
            # the components so far stand for their links
            roots = components(found if roots is None else roots.unionByName(found))
    labels = classes.join(roots.withColumnRenamed("u", "cls"), "cls", "left").select("cls", "rep", F.coalesce("v", "cls").alias("comp"))
    # a class alone in its component needs no join; the others meet a stored table of one row per component
    least = labels.groupBy("comp").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("comp", "least")
    least = staged(least, "join-least")
    answer = labels.join(least, "comp", "left").select(F.col("cls").alias("_cls"), F.coalesce("least", "rep").alias("component_id"))
    answer = staged(answer, "join-components")
    out = sets.join(answer, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
