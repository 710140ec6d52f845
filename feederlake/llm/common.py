"""What the text operators share: session settings, Arrow columns as bytes, words in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from feederlake.session import tune

#: Bytes of text that a task works on at a time; a longer text is cut by the operators themselves.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def prepare(spark: SparkSession, batch_mb: int = 4) -> SparkSession:
    """Session settings, and Arrow batches that stay small when texts are long."""
    tune(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", str(1000 * batch_mb)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_mb << 20)),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and its row offsets. NULL counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * kind().itemsize)
    bounds = bounds.astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def row_groups(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive rows [first, last) of about `limit` bytes together, one row at least."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def word_pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in lists of about `limit` bytes."""
    if len(text) <= limit:
        yield text.split()
        return
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def map_batches(
    df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[dict[str, object]]], schema: str
) -> DataFrame:
    """mapInArrow over batches; `per_batch` yields dictionaries of columns in the order of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in per_batch(batch):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)
