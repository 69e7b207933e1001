"""Arrow batches of texts as numpy buffers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batch_bytes(spark: SparkSession, limit: int):
    """What is run within the block goes to Python in batches of about ``limit`` bytes, for rows whose texts Python holds in pairs."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def text_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; a longer single text has a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(text_lengths(batch.column(batch.schema.get_field_index(text))))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, null as 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets.astype(np.int64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, end to end, and the offset of each text with the end last. Null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
