"""Clustering at scale: bounded zones along a space-filling curve, routes inside each zone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.geo import curve_place
from parcelwise.operators.area import dense_labels
from parcelwise.operators.clusters import by_shift, by_size
from parcelwise.operators.paths import PairTimes, RoadGraph, applied_with_times
from parcelwise.session import dealt, numbered, stored

ONE_ZONE, ZONE, MICRO = 2000, 1500, 10


def size_clusters(points: DataFrame, target: int, by: str, seed: int = 0) -> DataFrame:
    """points (point_id, lat, lon) with label, clusters of about `target` points, each value of `by` on its own, in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        return pd.DataFrame({"point_id": pdf["point_id"], "region": pdf["_region"], "label": by_size(pdf[["lat", "lon"]].to_numpy(float), target, seed=seed)})

    return dealt(points.select("point_id", "lat", "lon", F.col(by).cast("long").alias("_region")), "_region").groupBy("_region").applyInPandas(one, "point_id long, region long, label long")


def zoned(xy: np.ndarray, zone_points: int, micro: int = MICRO, seed: int = 0) -> np.ndarray:
    """Zones of about zone_points: micro clusters, each one's member nearest to its mean, those clustered again."""
    small = by_size(xy, micro, 1, seed)
    seats = []
    for c in range(small.max() + 1):
        own = xy[small == c]
        seats.append(own[np.linalg.norm(own - own.mean(0), axis=1).argmin()])
    return by_size(np.array(seats), max(1, round(zone_points / micro)), 2, seed)[small]


def split_zones(points: DataFrame, zone_points: int = ZONE, seed: int = 0) -> DataFrame:
    """point_id, bucket and zone. Buckets are stretches of a space-filling curve of two zones' points each."""
    placed = numbered(points.select("point_id", "lat", "lon", curve_place("lat", "lon").alias("_curve")), "_at", "_curve", "point_id")
    bucket = placed.withColumn("bucket", F.floor(F.col("_at") / (2 * zone_points)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        xy = pdf[["lat", "lon"]].to_numpy(float)
        zones = zoned(xy, zone_points, seed=seed) if len(xy) > zone_points else np.zeros(len(xy), int)
        return pd.DataFrame({"point_id": pdf["point_id"], "bucket": pdf["bucket"], "zone": zones})

    return dealt(bucket.select("point_id", "lat", "lon", "bucket"), "bucket").groupBy("bucket").applyInPandas(one, "point_id long, bucket long, zone long")


def plan_zones(points: DataFrame, seed: int = 0) -> DataFrame:
    """One zone under ONE_ZONE points, else zones of min(ZONE, a third of all points)."""
    n = points.count()
    if n < ONE_ZONE:
        return points.select("point_id", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("zone"))
    return split_zones(points, min(ZONE, math.floor(n / 3 + 0.5)), seed)


def shift_clusters(points: DataFrame, zones: DataFrame, graph: RoadGraph | None, depots: list[tuple[float, float, int]], per_stop: float = 300.0, shift: float = 36000.0, patience: int = 3, most_rounds: int = 100, seed: int = 0, durations: DataFrame | None = None) -> DataFrame:
    """point_id, bucket, zone and label: routes of each zone, numbered densely over all zones.

    points carry node_id; depots are (lat, lon, node_id). A zone is one group of bounded
    size, so the tasks are independent; only labels cross afterwards. Drive times come
    from the graph, or from `durations` if given.
    """
    seats, depot_nodes = np.array([d[:2] for d in depots], float), [int(d[2]) for d in depots]

    def one(pdf: pd.DataFrame, times: PairTimes) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        nodes = [int(x) for x in pdf["node_id"]]
        labels = by_shift(pdf[["lat", "lon"]].to_numpy(float), nodes, seats, depot_nodes, times, per_stop, shift, patience, seed, most_rounds)
        return pd.DataFrame({"point_id": pdf["point_id"], "bucket": pdf["bucket"], "zone": pdf["zone"], "zone_label": labels})

    rows = points.select("point_id", "lat", "lon", "node_id").join(zones, "point_id")
    made = applied_with_times(rows, ["bucket", "zone"], one, "point_id long, bucket long, zone long, zone_label long", graph, durations, depot_nodes)
    made = stored(made, "routes")  # ranked and joined below: the clustering must not run for both
    return dense_labels(made, "bucket", "zone", "zone_label").withColumnRenamed("dense_label", "label")


def stretches(stops: DataFrame, size: int = 2 * ZONE, shifted: bool = False) -> DataFrame:
    """label and region: whole clusters in the order of their centres on the curve, about `size` stops to a region.

    `shifted` moves the borders by half a region, so that clusters on two sides of a
    border share a region there.
    """
    centres = stops.groupBy("label").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))
    ordered = numbered(centres.select("label", "n", curve_place("lat", "lon").alias("_curve")), "_at", "_curve", "label")
    places = stops.select("label").join(ordered, "label").select("label", "_at")
    first = numbered(places, "_row", "_at").groupBy("label").agg(F.min("_row").alias("first"))
    return first.select("label", F.floor((F.col("first") + (size // 2 if shifted else 0)) / size).alias("region"))
