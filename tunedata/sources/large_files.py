"""SHA-256 of files of any length (S6) without a whole file in a row or a task.

SHA-256 reads a file's bytes one after the other, so its blocks can't be hashed apart; but its state is small.  The
bytes are read in parallel (Spark's text reader cuts files by byte ranges and gives the raw bytes of their lines), stored as pieces,
and hashed in rounds: a round takes the next ``ROUND`` bytes of every file, one task a file, and hands on the state.  ``hashlib`` keeps its
state to itself; OpenSSL's SHA256_Init, _Update and _Final keep it in a structure of 112 bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.session import scratch_dir, staged

#: bytes of a file that one task hashes in a round
ROUND = 128 * 1024 * 1024
#: names that the text reader would unpack
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz|lzo)$"
STATES = "file string, extra long, state binary, round int"


def resumable() -> bool:
    """Whether OpenSSL's library is here."""
    return ctypes.util.find_library("crypto") is not None


def _openssl():
    return ctypes.CDLL(ctypes.util.find_library("crypto"))


def sha256_state(state: bytes | None, parts: Iterator[bytes]) -> bytes:
    """The state after ``parts``, from an earlier one (None: the start)."""
    lib, held = _openssl(), ctypes.create_string_buffer(state or b"", 112)
    if state is None:
        lib.SHA256_Init(held)
    for p in parts:
        lib.SHA256_Update(held, ctypes.c_char_p(p), ctypes.c_size_t(len(p)))
    return held.raw


def sha256_hex(state: bytes) -> str:
    out, held = ctypes.create_string_buffer(32), ctypes.create_string_buffer(state, 112)
    _openssl().SHA256_Final(out, held)
    return out.raw.hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch that lie in one block of a file as one piece, numbered in the task."""
    seq = 0
    for batch in batches:
        file, block, size, line = (batch.column(c) for c in ("file", "block", "size", "line"))
        if not len(file):
            continue
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), len(file)]
        for a, b in zip(starts, starts[1:]):
            piece = pa.array([b"".join(line[a:b].to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([file[a:a + 1], block[a:a + 1], size[a:a + 1], pa.array([seq], pa.int64()), piece],
                                             ["file", "block", "size", "seq", "piece"])
            seq += 1


def _next_state(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A file's state after its next pieces.  The line break at their end waits for what follows; ``extra``: bytes of all pieces beyond the file's."""
    if not len(new) or not len(old):
        return old.iloc[:0][["file", "extra", "state", "round"]]
    extra, state = int(old["extra"].iloc[0]), old["state"].iloc[0]
    state = None if state is None else bytes(state)
    if extra not in (0, 1, -2, -3):
        raise ValueError(f"{old['file'].iloc[0]} changed while it was read, or is packed")
    pieces = [bytes(p) for p in new.sort_values(["block", "seq"])["piece"]]
    before = b"\n" if state is not None else b"\xef\xbb\xbf" if extra < 0 else b""         # the text reader skips the mark of UTF-8
    state = sha256_state(state, [before, *pieces[:-1], pieces[-1][:-1]])
    return pd.DataFrame({"file": [old["file"].iloc[0]], "extra": [extra], "state": [state], "round": [int(new["round"].iloc[0])]})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ends = [b"\n" if extra in (0, -3) else b"" for extra in pdf["extra"]]
        yield pd.DataFrame({"file": pdf["file"], "content_hash": [sha256_hex(sha256_state(bytes(s), [e])) for s, e in zip(pdf["state"], ends)]})


def large_file_hashes(spark: SparkSession, path_glob: str, over: int, longest: int, count: int, round_bytes: int = ROUND) -> DataFrame:
    """(file, content_hash) of the ``count`` files with more than ``over`` bytes; the longest has ``longest``."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * count)           # so that few files share a task
    scan = spark.read.option("lineSep", "\n").text(path_glob).where((F.col("_metadata.file_size") > over) & ~F.col("_metadata.file_name").rlike(PACKED))
    lines = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("_metadata.file_size").alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    pieces = lines.mapInArrow(_pieces, "file string, block long, size long, seq long, piece binary")
    path = scratch_dir(spark, "file-pieces")
    pieces.withColumn("round", F.floor(F.col("block") / round_bytes).cast("int")).write.partitionBy("round").parquet(path)
    stored = spark.read.schema("file string, block long, size long, seq long, piece binary, round int").parquet(path)
    total = stored.groupBy("file").agg((F.sum(F.length("piece").cast("long")) - F.max("size")).alias("extra"))
    states = staged(total.select("file", "extra", F.lit(None).cast("binary").alias("state"), F.lit(-1).alias("round")), "file-states")

    def latest(s: DataFrame) -> DataFrame:
        return s.groupBy("file").agg(F.max_by(F.struct("extra", "state", "round"), "round").alias("s")).select("file", "s.*")
    for k in range(longest // round_bytes + 1):
        now, held = (x.repartition(parts, "file").groupBy("file") for x in (stored.where(F.col("round") == k), states))
        after = now.cogroup(held).applyInPandas(_next_state, STATES)
        states = staged(latest(states.unionByName(after)), "file-states")
    return states.mapInPandas(_digests, "file string, content_hash string")
