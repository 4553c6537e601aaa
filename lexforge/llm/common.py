"""Shared pieces: durable intermediate tables, bounded Arrow slices, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that the vectorised passes look at together; a longer text is looked at in such pieces.
BLOCK = 1 << 20


#: Rows of a batch that goes to Python, while a durable table is written.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` set.

    Only a local session (tests, notebooks) that has none gets a temporary folder; on a cluster its absence is an
    error, as a folder of one machine would not be seen by the others.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "lexforge-" + spark.sparkContext.applicationId)
    return base.rstrip("/") + "/lexforge"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Batches that go to Python and back are held outside the heap, and rows may be long ones.
    rows = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexforge_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_lexforge_path", None)
        if path:
            remove(t.sparkSession, path)


#: Keys (longs, and what little stands beside them) that may be broadcast.
KEYS_SENT = 2_000_000


def few(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it is small enough, else joined as it is."""
    return F.broadcast(keys) if keys.count() <= KEYS_SENT else keys


def text_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (n + 1); nulls are empty. No per-row Python."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if len(col) else np.zeros(0, np.uint8)
    return (data[off[0] : off[-1]], off - off[0]) if len(col) else (data, np.zeros(1, np.int64))


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: a worker is used again for tasks that need theirs elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other systems' allocators do without
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that no slice of several rows holds much more than ``limit`` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_bytes(b.column(column))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
            yield b.slice(start, end - start)
            start = end
        del b, off
    tidy()


# --- words -----------------------------------------------------------------------------------------------------------

#: The bytes that end a word: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, U64(base), U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~SPACE[data]
    cut = np.zeros(n, bool)
    cut[off[:-1][off[:-1] < n]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order. Equal bytes hash alike wherever they stand."""
    out = np.empty(len(starts), U64)
    table = _TABLE[_LOWER] if lower else _TABLE
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        top = int(ends[j - 1])
        power, inverse = _power(top - base + 1)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum(table[data[base:top]] * power[:-1], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64)
        i = j
    return mix64(out)


def hash_words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order."""
    starts, ends, row = word_spans(data, off)
    return hash_spans(data, starts, ends, lower), row


def shingles(words: np.ndarray, row: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``n`` words of a row; a row of fewer words has one, its whole sequence."""
    if not len(words):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    mult = U64(0xC2B2AE3D27D4EB4F)
    h = words[: len(words) - n + 1].copy() if len(words) >= n else np.zeros(0, U64)
    for k in range(1, n):
        h = h * mult + words[k : len(words) - n + 1 + k]
    at = row[: len(h)]
    keep = at == row[n - 1 : n - 1 + len(h)]
    h, at = mix64(h[keep]), at[keep]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(row, short)
        own = np.zeros(len(short), U64)
        for k in range(n - 1):
            more = count[short] > k
            own[more] = own[more] * mult + words[begin[more] + k]
        own = mix64(own + count[short].astype(U64) * U64(0xA0761D6478BD642F))
        h, at = np.concatenate([h, own]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def stable_bucket(col, n: int):
    """A bucket number by a hash that is fixed across runs."""
    return F.pmod(F.xxhash64(col), F.lit(n))
