"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that one step of an operator holds at a time (a longer document is a step of its own).
STEP_BYTES = 2 << 20

#: Rows and bytes that go to a Python worker at once, where the session has Spark's defaults, which suit narrow rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, whose session from now on sends rows with whole texts in batches of bounded size, unless it has settings of its own.

    The settings stay with the session; no result depends on where batches end.
    """
    conf = frame.sparkSession.conf
    for name, (default, own) in BATCH.items():
        if conf.get(name) == default:
            conf.set(name, own)
    return frame


def unused(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that isn't taken."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name += "_"
    return name


def release() -> None:
    """Give memory back between tasks: workers stay, and the next stage may be another operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each value begins and the last ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def steps(batches: Iterator[pa.RecordBatch], *texts: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together have about ``limit`` bytes at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = sum(utf8(batch.column(text))[1] for text in texts)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()
