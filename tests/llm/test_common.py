import pyarrow as pa
import pytest

from parcelwise.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(("before", "after"), [("64m", str(common.BATCH_BYTES)), ("1g", str(common.BATCH_BYTES)), ("8m", "8m"), ("1024", "1024")])
def test_batches_are_bounded(spark, before, after):
    held = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, before)
        common.small_batches(spark.range(1))
        assert spark.conf.get(KEY) == after
    finally:
        spark.conf.set(KEY, held)


def test_text_buffers_of_a_slice():
    column = pa.array(["ab", None, "", "é", "z"]).slice(1, 3)
    offs, raw = common.text_buffers(column)
    assert offs.tolist() == [0, 0, 0, 2] and bytes(raw) == "é".encode()
    assert common.text_buffers(pa.array([], pa.string()))[0].tolist() == [0]


def test_blocks_hold_every_row_once():
    column = pa.array(["x" * n for n in (5, 0, 30, 3, 3, 3)] + [None])
    assert list(common.row_blocks(column, 9)) == [(0, 2), (2, 3), (3, 7)]
    assert list(common.row_blocks(column.slice(0, 0))) == []
