"""From road lines to a directed graph: box filter, segments, nodes, deduplicated edges, largest component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.session import numbered

MOST_EDGES = 30_000_000


def box_filter(roads: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Roads of which some segment meets the box, whole.

    Segments are clipped against the box (the parameter range along the segment that
    lies inside all four half planes), after a cheap test of the road's own extent.
    """

    def meets(a: Column, b: Column) -> Column:
        low, high = F.lit(0.0), F.lit(1.0)
        outside = F.lit(False)
        for at, to, least, most in ((a["lon"], b["lon"], min_lon, max_lon), (a["lat"], b["lat"], min_lat, max_lat)):
            step = to - at
            flat = step == 0.0
            first, second = (F.lit(least) - at) / F.nullif(step, F.lit(0.0)), (F.lit(most) - at) / F.nullif(step, F.lit(0.0))
            outside = outside | (flat & ((at < least) | (at > most)))
            low = F.when(flat, low).otherwise(F.greatest(low, F.least(first, second)))
            high = F.when(flat, high).otherwise(F.least(high, F.greatest(first, second)))
        return ~outside & (low <= high)

    g = F.col("geometry")
    of = lambda name: F.transform(g, lambda v: v[name])
    near = (F.array_max(of("lon")) >= min_lon) & (F.array_min(of("lon")) <= max_lon) & (F.array_max(of("lat")) >= min_lat) & (F.array_min(of("lat")) <= max_lat)
    steps = F.sequence(F.lit(1), F.greatest(F.size(g) - 1, F.lit(1)))
    return roads.where(near & F.exists(steps, lambda i: meets(F.get(g, i - 1), F.coalesce(F.get(g, i), F.get(g, i - 1)))))


def vertices(roads: DataFrame) -> DataFrame:
    """road_id, pos and the fixed-point coordinates of every vertex."""
    out = roads.select("road_id", F.posexplode("geometry").alias("pos", "v"))
    return out.select("road_id", "pos", geo.quantised("v.lat").alias("lat_i"), geo.quantised("v.lon").alias("lon_i"))


def nodes(roads: DataFrame) -> DataFrame:
    """Distinct vertices with a dense node_id in first-seen order: node_id, lat_i, lon_i, lat, lon."""
    seen = vertices(roads).groupBy("lat_i", "lon_i").agg(F.min(F.struct("road_id", "pos")).alias("first"))
    seen = seen.select("lat_i", "lon_i", "first.road_id", "first.pos")
    out = numbered(seen, "node_id", "road_id", "pos")
    return out.select("node_id", "lat_i", "lon_i", geo.dequantised("lat_i").alias("lat"), geo.dequantised("lon_i").alias("lon"))


def segments(roads: DataFrame) -> DataFrame:
    """Directed segments by coordinates: forward, and backward unless the road is one-way; (road_id, pos, dir) is their order."""
    g = F.transform("geometry", lambda v: F.struct(geo.quantised(v["lat"]).alias("lat"), geo.quantised(v["lon"]).alias("lon")))
    ways = F.when(geo.one_way("oneway", "junction"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    pairs = roads.where(F.size("geometry") > 1).select("road_id", "highway", ways.alias("ways"), F.posexplode(F.arrays_zip(F.slice(g, 1, F.size("geometry") - 1).alias("a"), F.slice(g, 2, F.size("geometry") - 1).alias("b"))).alias("pos", "s"))
    out = pairs.select("road_id", "highway", "pos", "s", F.explode("ways").alias("dir"))
    swap = F.col("dir") == 1
    return out.select("road_id", "pos", "dir", "highway", F.when(swap, F.col("s.b")).otherwise(F.col("s.a")).alias("u"), F.when(swap, F.col("s.a")).otherwise(F.col("s.b")).alias("v"))


def edges(roads: DataFrame, node_table: DataFrame, default_kmh: float | None = None) -> DataFrame:
    """start, end, highway, coordinates, distance (m) and duration (s); of equal edges the last road's class counts.

    Segments are deduplicated by coordinates first, so node ids are joined to distinct edges only.
    """
    last = segments(roads).groupBy("u", "v").agg(F.max_by("highway", F.struct("road_id", "pos", "dir")).alias("highway"))
    at = lambda end, name: node_table.select(F.struct(F.col("lat_i").alias("lat"), F.col("lon_i").alias("lon")).alias(end), F.col("node_id").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    out = last.join(at("u", "start"), "u").join(at("v", "end"), "v").drop("u", "v")
    metres = geo.haversine_km("start_lat", "start_lon", "end_lat", "end_lon") * 1000.0
    out = out.withColumn("distance", metres)
    return out.withColumn("duration", geo.drive_seconds("distance", geo.speed_kmh("highway", default_kmh)))


def largest_component(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Node ids of the largest strongly connected component; ties go to the one with the least node id.

    Forward and backward breadth-first sweeps from a pivot over CSR arrays: what both
    reach is the pivot's component; it goes, and so on until no rest can be larger.
    """
    names, flat = np.unique(np.concatenate([start, end]), return_inverse=True)
    n, a, b = len(names), flat[: len(start)], flat[len(start) :]

    def adjacency(x, y):
        order = np.argsort(x, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]), y[order]

    graphs = adjacency(a, b), adjacency(b, a)
    alive, best = np.ones(n, bool), np.zeros(0, np.int64)

    def reach(pivot, graph):
        first, to = graph
        seen = np.zeros(n, bool)
        seen[pivot] = True
        front = np.array([pivot])
        while len(front):
            sizes = first[front + 1] - first[front]
            rows = np.repeat(first[front] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            front = np.unique(to[rows])
            front = front[alive[front] & ~seen[front]]
            seen[front] = True
        return seen

    degree = np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n))
    while alive.sum() > len(best) or (alive.any() and alive.sum() == len(best) and names[alive].min() < names[best].min()):
        left = np.flatnonzero(alive)
        pivot = left[np.argmax(degree[left])]
        own = np.flatnonzero(reach(pivot, graphs[0]) & reach(pivot, graphs[1]))
        if len(own) > len(best) or len(own) == len(best) and names[own[0]] < names[best[0]]:
            best = own
        alive[own] = False
    return names[best]


def refuse_large(edge_table: DataFrame, most: int = MOST_EDGES) -> None:
    if (n := edge_table.count()) > most:
        raise ValueError(f"{n} edges are more than a task can hold ({most}); plan a smaller area")


def largest_scc(edge_table: DataFrame) -> DataFrame:
    """node_id of the largest strongly connected component.

    The two id columns of the road graph come to the driver: the planner broadcasts the
    whole graph to every task anyway. A planning area spans 300 km at most, which bounds
    it; a graph of over MOST_EDGES edges is refused.
    """
    refuse_large(edge_table)
    ids = edge_table.select("start", "end").toPandas()
    if ids.empty:
        raise ValueError("the road graph has no edges")
    found = largest_component(ids["start"].to_numpy(), ids["end"].to_numpy())
    return edge_table.sparkSession.createDataFrame([(int(x),) for x in found], "node_id long")


def node_coordinates(node_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node_id, ...) with lat and lon; unknown nodes get nulls."""
    return wanted.join(node_table.select("node_id", "lat", "lon"), "node_id", "left")


def inside(edge_table: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges of which both ends are kept nodes."""
    for end in ("start", "end"):
        edge_table = edge_table.join(kept.select(F.col("node_id").alias(end)), end, "left_semi")
    return edge_table
