"""Byte-level scanning of batches of texts in numpy, shared by operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrow batches between the JVM and Python workers have about this many bytes, where the session doesn't set another size.
BATCH_BYTES = 4 << 20


def slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts (or other sequences) of about `most` characters; a longer one is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield begin, len(texts)


def spans(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(x):
        return []
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return list(zip(begin, [*begin[1:], len(x)], strict=True))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, each ended by a line feed, and the places where they end."""
    parts = [t.encode() for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), np.cumsum(size)


def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x between consecutive ends."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return np.diff(total[np.concatenate([[0], ends])])


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches, with the column's texts; nulls are empty texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        for a, b in slices(texts, most):
            yield batch.slice(a, b - a), texts[a:b]
    trim()


def trim() -> None:
    """Gives freed memory back to the system at the end of a task: workers are used again, and others share their machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of df's session by BATCH_BYTES, so that long texts don't meet 10,000 at a time; another size than Spark's own stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).rstrip("b") == str(64 << 20):
        conf.set(name, str(BATCH_BYTES))
