"""Token-pair statistics: clipped multiset overlaps on the JVM, LCS lengths in one Arrow UDF.

* Overlap: sum over tokens of min(count in a, count in b).  Equal tokens of a side are numbered (sorted array, starts of
  runs), which makes a multiset a set of (token, occurrence); the built-in ``array_intersect`` hashes both sides.  Linear but
  for the sort, inside the row, no shuffle.
* LCS has no built-in; a nested higher-order function would be quadratic and interpreted.  Spark ships the token arrays in Arrow
  batches, and a small helper runs the bit-parallel algorithm of Allison-Dix / Hyyro over Python integers used as bit
  vectors, O(m*n/64) instead of the O(m*n) table.  A token takes several times its Arrow bytes as a Python string, so a batch
  becomes Python objects a few rows at a time, and the bit vectors of a long text are made for one block of it at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ------------------------------------------------------------------- overlaps
def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def bigrams(tokens: Column) -> Column:
    """Pairs of neighbouring tokens, joined by a space (tokens hold none)."""
    return F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat(F.get(tokens, i), F.lit(" "), t))


def _numbered(tokens: Column) -> Column:
    """The first occurrence of each token as it is, the k-th repeat as ``token <line break> k``: a set as large as the multiset."""
    none = F.array().cast("array<string>")

    def numbered(again: Column) -> Column:
        """Repeats (sorted): runs of equal tokens, numbered from their starts."""
        starts = F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda i: F.coalesce(F.get(again, i) != F.get(again, i - 1), F.lit(True)))
        runs = _let(starts, lambda r: F.flatten(F.transform(r, lambda a, j: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(r, j + 1), F.size(again)) - a), lambda k: F.concat(F.get(again, a), F.lit("\n"), k.cast("string"))))))
        return F.when(F.size(again) > 0, runs).otherwise(none)

    def split(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))
        return F.concat(F.array_distinct(s), _let(again, numbered))
    return _let(F.sort_array(tokens), split)


def overlap(a: Column, b: Column) -> Column:
    """Clipped multiset intersection size of two ``array<string>`` columns without null tokens."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


# --------------------------------------------------------------- replaced tokens
def replaced(tokens: Column, entries: Column) -> Column:
    """Tokens with those of ``entries`` (structs ``t`` token, ``i`` -1, ``s`` replacement; the greatest of a token counts) replaced, in their order.

    Both sorted together, an entry stands before its tokens; a map would be searched from its start for each token.
    """
    first = F.array(F.struct(F.lit("").alias("t"), F.lit(-1).alias("i"), F.lit("").alias("s")))          # before all tokens
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.lit(None).cast("string").alias("s")))

    def put(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.get(s, k)["i"] < 0)

        def run(head: Column, a: Column, to: Column) -> Column:
            return F.transform(F.slice(s, a + 2, to - a - 1), lambda x: F.struct(
                x["i"].alias("i"), F.when(x["t"] == head["t"], head["s"]).otherwise(x["t"]).alias("t")))
        runs = _let(heads, lambda h: F.flatten(F.transform(h, lambda a, j: run(F.get(s, a), a, F.coalesce(F.get(h, j + 1), F.size(s))))))
        return F.transform(F.array_sort(runs), lambda x: x["t"])
    return _let(F.array_sort(F.concat(first, entries, placed)), put)


def in_position_order(lists: Column) -> Column:
    """Token arrays as one array: all first tokens, all second ones, and so on."""
    placed = F.flatten(F.transform(lists, lambda a: F.transform(a, lambda t, i: F.struct(i.alias("i"), t.alias("t")))))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


# ------------------------------------------------------------------------ LCS
#: tokens of a text whose bit vectors are in memory together, and rows of a batch that are Python objects together
BLOCK, ROWS = 8192, 64


def lcs_length(a, b, block: int = BLOCK) -> int:
    """LCS length of two token sequences.

    The bit vector over ``a`` is cut into blocks: a block runs through all of ``b`` and leaves the carry of each step to the next one,
    as in an addition of many words.
    """
    if a is None or b is None or len(b) == 0:
        return 0
    found, carry = 0, bytearray(len(b) if len(a) > block else 0)
    for start in range(0, len(a), block):
        part = a[start:start + block]
        m = len(part)
        positions: dict = {}
        for i, tok in enumerate(part):
            positions[tok] = positions.get(tok, 0) | (1 << i)
        v = full = (1 << m) - 1
        if carry:
            for k, tok in enumerate(b):
                match = positions.get(tok)
                if match or carry[k]:
                    u = v & match if match else 0
                    total = v + u + carry[k]
                    carry[k] = total >> m
                    v = (total | (v - u)) & full
        else:
            for tok in b:
                match = positions.get(tok)
                if match:
                    u = v & match
                    v = ((v + u) | (v - u)) & full
        found += m - v.bit_count()
    return found


_UDFS: dict = {}


def _lcs_udf():
    @F.arrow_udf(T.IntegerType())
    def lcs_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list[int] = []
        for i in range(0, len(a), ROWS):
            some = (x.slice(i, ROWS).to_numpy(zero_copy_only=False) for x in (a, b))
            out += [lcs_length(x, y) for x, y in zip(*some)]
        return pa.array(out, pa.int32())
    return lcs_lengths


def lcs(a: Column, b: Column) -> Column:
    """LCS length of two ``array<string>`` columns."""
    if "lcs" not in _UDFS:                                       # made on first use: a UDF needs no session before
        _UDFS["lcs"] = _lcs_udf()
    return _UDFS["lcs"](a, b)
