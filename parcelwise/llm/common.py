"""What the operators of this subpackage share: text buffers, blocks of rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that one numpy step works on; its temporaries are a small multiple of this.
BLOCK_BYTES = 4 << 20


#: Bytes of an Arrow batch between JVM and Python at most; a longer text stands alone.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends Arrow batches of BATCH_BYTES at most from now on, unless it asks for less.

    A batch is held some four times at once: outside the heap, in the worker, and on the
    way back. With the default of 64 MB, two tasks of an executor need half a GB for it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)\s*([kmg]?)", conf.get(key).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a table comes in fewer parts than there are cores, as a small file in one row group does.

    The same rows either way; tables of any size worth the name come in more parts, and then nothing is exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def row_blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """Ranges (start, stop) of rows whose texts have about `most` bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def by_blocks(batches, text: str, f, most: int = BLOCK_BYTES):
    """f(block) for blocks of rows of the Arrow batches, bounded by the bytes of their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for start, stop in row_blocks(column, most):
            yield f(batch.slice(start, stop - start))


def renamed(batch: pa.RecordBatch, **more) -> pa.RecordBatch:
    """batch with further columns; those of the same name are replaced."""
    names = [n for n in batch.schema.names if n not in more]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(more.values()), names=names + list(more))
