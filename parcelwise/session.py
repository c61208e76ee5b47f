"""Storage that driver and executors share, and row numbers without a single-task window."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="parcelwise-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder, gone with the process, serves a
    local master only; executors of any other master would each see another folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
    return _own_folder()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage; `released` removes those of a block."""
    path = f"{shared_base(spark).rstrip('/')}/parcelwise/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written once to shared storage and read back, and its folder."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to shared storage and read back: it cuts lineage and survives lost executors."""
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of shared storage that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at the end what the block has put in shared storage; results made from it must be written by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            discard(spark, path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over all shuffle partitions. Adaptive execution would merge them by their bytes,
    and so run the few rows of many slow groups in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `name`, the row's place from 0 in the order of the columns `order`.

    Rows are dealt by range and stored with their place in their partition; the
    partitions' sizes, one row each, give the offsets.
    """
    held = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy(F.shiftright("_place", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(offsets, "_part long, _first long")
    place = F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_first")
    out = held.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(first), "_part")
    return out.withColumn(name, place).drop("_part", "_place", "_first")
