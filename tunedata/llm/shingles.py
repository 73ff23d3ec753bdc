"""Word-shingle sets of whole Arrow text batches, without a Python loop over words.

A word is a run of bytes that are not ASCII white space, A-Z lower-cased.  Words hash by a
polynomial over their bytes, shingles by one over their word hashes, both finished with a 64-bit mixer.
Blocks of bytes end at word ends, so the memory needed does not depend on the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_A = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column (null rows are empty)."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _block_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of one block; ``breaks``: positions where a row starts."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    first[breaks] = word[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    low += np.uint64(1)
    low[space] = 0
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    top = int(place[word].max()) + 1
    place[space] = 0
    powers = np.cumprod(np.full(top, _P, dtype=np.uint64))
    return starts, mix(np.add.reduceat(low * powers[place], starts))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the column, in order."""
    data, offsets = _bytes(texts)
    begins, hashes = [], []
    rows = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    a = 0
    while a < len(data):
        b = min(a + BLOCK, len(data))
        while b < len(data):                                     # end the block after a white-space byte or a row
            near = data[b - 1:b + BLOCK]
            gap = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            row = rows[np.searchsorted(rows, b)] if rows[-1] >= b else len(data)
            stop = min(b + int(gap[0]) if len(gap) else b + len(near), int(row))
            if len(gap) or stop == row or stop == len(data):
                b = stop
                break
            b = stop
        here = rows[np.searchsorted(rows, a):np.searchsorted(rows, b)] - a
        s, h = _block_words(data[a:b], here)
        begins.append(s + a)
        hashes.append(h)
        a = b
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.concatenate(begins)
    return np.searchsorted(offsets, at, side="right") - 1, np.concatenate(hashes)


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row bounds, hashes): the distinct ``k``-word shingles of row i are ``hashes[bounds[i]:bounds[i + 1]]``, sorted.

    A row with fewer than ``k`` words has one shingle (all its words); without words it has none.
    """
    n = len(texts)
    row, h = words(texts)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    acc = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        acc = acc * _A + h[j:j + len(acc)]
    inside = row[:len(acc)] == row[k - 1:k - 1 + len(acc)]
    rows, out = [row[:len(acc)][inside]], [mix(acc[inside])]
    for size in range(1, k):                                     # short rows: the whole sequence
        short = np.flatnonzero(count == size)
        one = np.full(len(short), np.uint64(size), np.uint64)
        for j in range(size):
            one = one * _A + h[first[short] + j]
        rows.append(short)
        out.append(mix(one ^ np.uint64(0x5851F42D4C957F2D)))
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    rows, out = rows[new], out[new]
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), out
