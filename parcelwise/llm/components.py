"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.session import discard, stored_at


def connected(links: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node in links (a, b): component is the least node reachable.

    Each round joins every node's larger neighbours to its least one, then its smaller
    neighbours to the least of them, until nothing changes; paths shorten to their
    logarithm. Minima are pre-aggregated, and a node with very many neighbours only
    meets its minimum in a join that adaptive execution can split. Rounds are stored in
    shared storage, the one before being removed; only a count and a checksum reach the
    driver. Rounds end when a round changes nothing, however many that takes.
    """
    spark = links.sparkSession
    edges, path = stored_at(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}-links")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")).first()
        if tuple(mark) == seen or not mark["n"]:
            break
        seen = tuple(mark)
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        before, (edges, path) = path, stored_at(small, f"{name}-stars")
        discard(spark, before)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
