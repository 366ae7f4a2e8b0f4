"""Helpers shared by the training-data operators: small Arrow tasks, column names, text access."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficjobs.session import drop_tables, materialize, small, tables  # noqa: F401  for the operators

#: Code units handled at once inside a task, which bounds its memory.
CHUNK = 1_000_000
#: Rows of an Arrow batch of texts, where the session does not set it.
ARROW_ROWS, ARROW_KEY = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _give_back() -> None:
    """Freed memory goes back to the system, so that a Python worker that Spark keeps for later stages is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for texts: small batches, and nothing held by the worker after the task. run takes columns by place, not by name.

    Spark takes the size of batches from the session when it runs a plan, so a session that has none set gets ARROW_ROWS;
    a value that was set, Spark's default too, stays.
    """
    conf = df.sparkSession.conf
    if any("." in c or "`" in c for c in df.columns):  # mapInArrow itself does not quote them
        df = df.toDF(*(f"_{k}" for k in range(len(df.columns))))
    if ARROW_KEY not in conf.getAll:
        conf.set(ARROW_KEY, str(ARROW_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def named(df: DataFrame, *dropped: str) -> list:
    """The columns of df by quoted name, but the dropped ones, whose case does not matter."""
    gone = {d.lower() for d in dropped}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, underscored until no column of df has them in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(offsets: np.ndarray, size: int = CHUNK):
    """Row ranges of about size units each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one line feed, and the offsets of the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
