"""Packing of tokenised documents into sequences: online sum-of-squares bin packing.

Every input partition packs its own documents (no shuffle).  A document longer than a
sequence gives full sequences and a rest.  The rest of ``s`` tokens goes to the fill level ``h``
(or a new window) that makes the sum of the squared counts ``N(h)^2`` of partially filled
windows least: taking a window from ``h`` to ``h + s`` changes it by
``-2 N(h) + 1 + 2 N(h + s) + 1``; a new window has no first part, a full one no second part.
The counts are an array over the levels, so a placement is one argmin over at most
``size`` numbers.

Open windows are kept in memory (at most ``max_open`` of them).  At the end of a partition, or
beyond that number, they are flushed: the emptiest windows are cut to fill the gaps of
the fullest, so a flush leaves one partial window.  Padding is then at most one window per
partition and flush, whatever the documents look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.llm.tokens import encode, public_path

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: rows and bytes of an output batch
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


class Packer:
    """Online packer of one partition; ``closed`` collects (sequence number, pieces)."""

    def __init__(self, size: int = 1024, max_open: int = 4096):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, dtype=np.int64)          # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open, self.next_id = 0, 0
        self.closed: list[tuple[int, list]] = []

    def _close(self, pieces: list) -> None:
        self.closed.append((self.next_id, pieces))
        self.next_id += 1

    def level_for(self, s: int) -> int:
        """Fill level (0: a new window) whose choice makes the sum of squares least; the fullest on ties."""
        n, c = self.size, self.count
        after = 2 * c[s:n + 1] + 1                                # the level reached from h = 0 .. n - s
        after[-1] = 0                                             # a full window is not partial
        change = after - 2 * c[:n - s + 1] + 1
        change[c[:n - s + 1] == 0] = np.iinfo(np.int64).max
        change[0] = after[0]                                      # a new window
        return n - s - int(np.argmin(change[::-1]))

    def add(self, piece: tuple) -> None:
        """Place one piece: (document key, start, ids, document tokens), at most ``size`` ids."""
        s = len(piece[2])
        if s == self.size:
            self._close([piece])
            return
        h = self.level_for(s)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if h + s == self.size:
            self._close(window)
            return
        self.open[h + s].append(window)
        self.count[h + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.flush()

    def document(self, key, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.size):
            self.add((key, start, ids[start:start + self.size], len(ids)))

    def flush(self) -> None:
        """Close all open windows: the emptiest ones are cut into the gaps of the fullest."""
        windows = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]
        self.open = [[] for _ in range(self.size + 1)]
        self.count[:] = 0
        self.n_open = 0
        i, j = 0, len(windows) - 1
        while i < j:
            (have, left), (rest, right) = windows[i], windows[j]
            while have < self.size and right:
                key, start, ids, total = right.pop()
                room = self.size - have
                left.append((key, start, ids[:room], total))
                if len(ids) > room:
                    right.append((key, start + room, ids[room:], total))
                moved = min(room, len(ids))
                have, rest = have + moved, rest - moved
            windows[i], windows[j] = (have, left), (rest, right)
            i += have == self.size
            j -= not right
        for _, pieces in windows[:j + 1]:
            if pieces:
                self._close(pieces)


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, size: int, max_open: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 36                # sequence ids of this partition start here
    packer = Packer(size, max_open)
    rows: list[tuple] = []
    held = 0

    def drain():
        nonlocal held
        for number, pieces in packer.closed:
            offset = 0
            for key, start, ids, total in pieces:
                rows.append((key, start, len(ids), ids.tobytes(), total, first + number, offset))
                offset += len(ids)
            held += 4 * offset
        packer.closed.clear()

    def batch() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        held = 0
        return out

    for b in batches:
        keys, texts = b.column(0), b.column(1)
        for i in range(b.num_rows):
            ids = encode(texts[i].as_py(), path)
            packer.document(keys[i].as_py(), np.append(ids, np.uint32(0)).astype("<u4"))
            drain()
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
    packer.flush()
    drain()
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   size: int = 1024, max_open: int = 4096) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``ids`` are the piece's token ids (little-endian unsigned 32-bit).  A document is its ids and a
    closing id 0; a null or empty text is that one id.  Each id lies in exactly one piece; a
    sequence is filled from offset 0 without gaps.  Repeated rows are packed each.  Null ids stay
    null.  Other columns are not looked at.  An empty table gives an empty result.

    ``docs`` should be a stored table: a recomputed partition then has the same rows in the
    same order and gives the same sequences.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    path = path or public_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *T._parse_datatype_string(SCHEMA).fields])
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda it: _packed(it, arrow, path, size, max_open), schema)
