"""Helpers shared by the operators: materialised tables, bounded Arrow slices and byte arithmetic."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgelens.session import scratch_path

#: Text bytes that a task works on at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there,
    and a lost executor costs a re-read, not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's limit of the bytes in an Arrow batch, and its value where nobody has set it.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_arrow(df: DataFrame, run: Callable, ddl) -> DataFrame:
    """``df.mapInArrow`` with batches of about SLICE_BYTES: what a worker and the JVM's buffers hold at a time does not
    follow the texts' length.  The session's own limit stays if it was set; otherwise it is set for the session.
    A worker that waits for its next task does not hold what this one has freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    if df.sparkSession.conf.get(BATCH_BYTES, BATCH_DEFAULT) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_BYTES, f"{SLICE_BYTES}b")
    return df.mapInArrow(task, ddl)


_STATE: dict = {}


def worker_state(key, make: Callable):
    """What a Python worker keeps from task to task, made on its first use.  Workers serve one operator after another,
    so what another one has kept is dropped first, and its memory given back."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            give_back()
        _STATE[key] = make()
        give_back()
    return _STATE[key]


def give_back() -> None:
    """Return the memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        sizes = byte_lengths(batch.column(column))
        ends, start, n = np.cumsum(sizes), 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text (0 for null)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, others spread evenly."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def words64(buffer: np.ndarray) -> np.ndarray:
    """At each place of a byte array (8 spare bytes at its end) the 64-bit little-endian word starting there."""
    n = len(buffer) - 8
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out |= buffer[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def key_column(name: str):
    return F.col(f"`{name}`")


def free_name(docs: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``docs`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in docs.columns}
    while base.lower() in taken:
        base += "_"
    return base


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """A few arrays as one compressed value."""
    import zstandard

    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    head = np.array([len(parts), *(len(x) for x in parts)], dtype="<i8").tobytes()
    return zstandard.compress(head + b"".join(parts), 1)


def unpack(raw: bytes, *kinds: str) -> list:
    import zstandard

    raw = zstandard.decompress(raw)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<i8", count=n + 1)[1:]
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [raw[e - s : e] if kind == "raw" else np.frombuffer(raw[e - s : e], dtype=kind) for e, s, kind in zip(ends.tolist(), sizes.tolist(), kinds, strict=True)]
