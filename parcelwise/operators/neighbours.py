"""Nearest-neighbour joins on the plane of degrees, by boxes along a space-filling curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.geo import curve_place, degrees_apart
from parcelwise.session import numbered, stored

LEAF, FAN = 64, 16  # candidates of a leaf at least, boxes below a box
SLACK = 1e-9  # of a distance, for its rounding


def boxes(members: DataFrame, node) -> DataFrame:
    """The extent and number of candidates of each node, from its members' extents."""
    return members.groupBy(node.alias("node")).agg(F.min("lat0").alias("lat0"), F.max("lat1").alias("lat1"), F.min("lon0").alias("lon0"), F.max("lon1").alias("lon1"), F.sum("n").alias("n"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, others_only: bool = False) -> DataFrame:
    """The k nearest candidates (cand_id, lat, lon) of each query (query_id, lat, lon): query_id, cand_id, dist, rank from 1.

    Ties go to the lower cand_id; with others_only a candidate of the query's own id does
    not count. Distinct coordinates are what is joined: candidates at one place are cut to
    the k + 1 lowest ids, all that any query can need, so crowded places stay bounded.

    Candidates in the order of a space-filling curve are cut into leaves of equal number,
    whatever their density, FAN leaves into a box, FAN boxes into a box, up to one. Every
    query's place walks down from the top: a box that holds enough candidates bounds the
    distance of the last one needed by its far corner, and boxes whose near side is beyond
    that are left. What a place meets is a few leaves, in a town as in the desert; boxes
    with many queries are split by adaptive execution, as any join key.
    """
    need = k + 1 if others_only else k
    size = max(LEAF, need)
    per_place = Window.partitionBy("lat", "lon").orderBy("cand_id")
    some = candidates.select(F.col("cand_id").cast("long").alias("cand_id"), "lat", "lon").withColumn("_n", F.row_number().over(per_place)).where(F.col("_n") <= k + 1).drop("_n")
    held = stored(numbered(some.withColumn("_curve", curve_place("lat", "lon")), "_at", "_curve", "cand_id").select("cand_id", "lat", "lon", F.floor(F.col("_at") / size).alias("leaf")), "candidates")
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), "lat", "lon"), "queries")
    leaves = boxes(held.select("leaf", F.col("lat").alias("lat0"), F.col("lat").alias("lat1"), F.col("lon").alias("lon0"), F.col("lon").alias("lon1"), F.lit(1).alias("n")), F.col("leaf"))
    levels = [stored(leaves, "boxes")]
    n = levels[0].count()
    while n > 1:
        levels.append(boxes(levels[-1], F.floor(F.col("node") / FAN)))
        n = -(-n // FAN)
    places = asked.where("lat is not null and lon is not null").select("lat", "lon").distinct().withColumn("node", F.lit(0).cast("long"))
    here = Window.partitionBy("lat", "lon")
    for below in levels[-2::-1]:
        child = below.withColumn("parent", F.floor(F.col("node") / FAN)).withColumnRenamed("node", "child")
        met = places.join(child, F.col("node") == F.col("parent"))
        beyond = lambda x, low, high: F.greatest(F.col(low) - F.col(x), F.col(x) - F.col(high), F.lit(0.0))
        across = lambda x, low, high: F.greatest(F.abs(F.col(x) - F.col(low)), F.abs(F.col(x) - F.col(high)))
        length = lambda f: F.sqrt(F.pow(f("lat", "lat0", "lat1"), 2.0) + F.pow(f("lon", "lon0", "lon1"), 2.0))
        met = met.select("lat", "lon", F.col("child").alias("node"), length(beyond).alias("near"), F.when(F.col("n") >= need, length(across)).alias("far"))
        reach = F.coalesce(F.min("far").over(here) * (1 + SLACK), F.lit(float("inf")))
        places = met.withColumn("reach", reach).where(F.col("near") <= F.col("reach")).select("lat", "lon", "node")
    theirs = held.select("cand_id", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.col("leaf").alias("node"))
    order = here.orderBy("dist", "cand_id")
    found = places.join(theirs, "node").select("lat", "lon", "cand_id", degrees_apart("lat", "lon", "to_lat", "to_lon").alias("dist"))
    found = found.withColumn("place_rank", F.row_number().over(order)).where(F.col("place_rank") <= need)
    out = asked.join(found, ["lat", "lon"])
    if others_only:
        out = out.where(F.col("query_id") != F.col("cand_id"))
    by = Window.partitionBy("query_id").orderBy("dist", "cand_id")
    return out.select("query_id", "cand_id", "dist").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def snap(points: DataFrame, node_table: DataFrame) -> DataFrame:
    """point_id and the node_id nearest to it."""
    found = nearest(points.select(F.col("point_id").alias("query_id"), "lat", "lon"), node_table.select(F.col("node_id").alias("cand_id"), "lat", "lon"), 1)
    return found.select(F.col("query_id").alias("point_id"), F.col("cand_id").alias("node_id"), "dist")


def knn_pairs(points: DataFrame, k: int = 50) -> DataFrame:
    """Each point's k - 1 nearest other points: point_id, near_id, dist, rank."""
    ids = points.select(F.col("point_id").alias("id"), "lat", "lon")
    found = nearest(ids.withColumnRenamed("id", "query_id"), ids.withColumnRenamed("id", "cand_id"), k - 1, True)
    return found.select(F.col("query_id").alias("point_id"), F.col("cand_id").alias("near_id"), "dist", "rank")


def nearest_depot(centres: DataFrame, depots: DataFrame, most_seats: int = 1000) -> DataFrame:
    """label and the warehouse_id nearest to its centre (lat, lon), ties to the lowest id.

    Up to most_seats depots are broadcast and all compared; more go through the grid.
    """
    if depots.limit(most_seats + 1).count() > most_seats:
        found = nearest(centres.select(F.col("label").alias("query_id"), "lat", "lon"), depots.select(F.col("warehouse_id").cast("long").alias("cand_id"), "lat", "lon"), 1)
        return found.select(F.col("query_id").alias("label"), F.col("cand_id").cast("int").alias("warehouse_id"), "dist")
    seats = F.broadcast(depots.select("warehouse_id", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")))
    met = centres.join(seats).withColumn("dist", degrees_apart("lat", "lon", "to_lat", "to_lon"))
    return met.groupBy("label").agg(F.min_by("warehouse_id", F.struct("dist", "warehouse_id")).alias("warehouse_id"), F.min("dist").alias("dist"))


def distinct_pairs(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Unordered pairs a < b, once each, without those already known (a, b)."""
    out = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return out if known is None else out.join(known.select("a", "b"), ["a", "b"], "left_anti")


def pairs_within(rows: DataFrame, *key: str, of: str = "node_id") -> DataFrame:
    """Key, a and b: all unordered pairs of distinct values of a group, whose size the caller bounds (a route, a zone)."""
    own = rows.select(*key, F.col(of).alias("a")).distinct()
    return own.join(own.withColumnRenamed("a", "b"), list(key)).where("a < b")


def neighbour_node_pairs(stops: DataFrame, k: int = 50, known: DataFrame | None = None) -> DataFrame:
    """a, b: the road nodes of each stop and its k - 1 nearest other stops, unordered, once each, without those known.

    stops: point_id, lat, lon, node_id. Stops at one node make no pair.
    """
    near = knn_pairs(stops, k).select("point_id", "near_id")
    at = stops.select("point_id", "node_id")
    pairs = near.join(at.withColumnRenamed("node_id", "a"), "point_id").join(at.select(F.col("point_id").alias("near_id"), F.col("node_id").alias("b")), "near_id")
    return distinct_pairs(pairs.select("a", "b"), known)
