"""Planning area: bounding box, span guard, bags of points, centres and spreads of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.geo import KM_PER_DEGREE, degrees_apart, haversine_km
from parcelwise.session import numbered

MOST_SPAN_KM, MARGIN_KM = 300.0, 10.0


def bag_of_points(points: DataFrame, depots: DataFrame) -> DataFrame:
    """Points and depots together, repeats kept: (lat, lon)."""
    return points.select("lat", "lon").unionByName(depots.select("lat", "lon"))


def extent(points: DataFrame, depots: DataFrame) -> DataFrame:
    """One row: least and greatest coordinates and the spans in km."""
    box = bag_of_points(points, depots).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    middle = F.radians((F.col("min_lat") + F.col("max_lat")) / 2.0)
    return box.select("*", ((F.col("max_lat") - F.col("min_lat")) * KM_PER_DEGREE).alias("lat_km"), ((F.col("max_lon") - F.col("min_lon")) * KM_PER_DEGREE * F.cos(middle)).alias("lon_km"))


def guarded(box: DataFrame, most_km: float = MOST_SPAN_KM) -> DataFrame:
    """The extent; it raises when a span is over most_km."""
    wide = (F.col("lat_km") > most_km) | (F.col("lon_km") > most_km)
    refused = F.when(wide, F.raise_error(F.lit(f"the area spans over {most_km:g} km")).cast("double"))
    return box.select(*(F.coalesce(refused, F.col(c)).alias(c) for c in box.columns))  # on every column, so that none can be pruned away


def bounding_box(points: DataFrame, depots: DataFrame, margin_km: float = MARGIN_KM) -> DataFrame:
    """One row: min_lon, min_lat, max_lon, max_lat of all points and depots, widened by margin_km."""
    middle = F.radians((F.col("min_lat") + F.col("max_lat")) / 2.0)
    up, side = F.lit(margin_km) / KM_PER_DEGREE, F.lit(margin_km) / (F.lit(KM_PER_DEGREE) * F.cos(middle))
    box = guarded(extent(points, depots))
    return box.select((F.col("min_lon") - side).alias("min_lon"), (F.col("min_lat") - up).alias("min_lat"), (F.col("max_lon") + side).alias("max_lon"), (F.col("max_lat") + up).alias("max_lat"))


def cluster_means(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n_points"))


def weighted_centroids(labelled: DataFrame, threshold: float = 1.0) -> DataFrame:
    """By label, the centre with weights exp(-d / threshold), d in degrees from the mean.

    The means come back by a join on the label, whose table is as small as the labels
    are few, so that a very large cluster is aggregated in parts and never windowed.
    """
    means = labelled.groupBy("label").agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    weight = F.exp(-degrees_apart("lat", "lon", "mean_lat", "mean_lon") / threshold)
    near = labelled.select("label", "lat", "lon").join(means, "label").withColumn("w", weight)
    return near.groupBy("label").agg((F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("lat"), (F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("lon"))


def size_spread(labelled: DataFrame) -> DataFrame:
    """One row: clusters, least, greatest and total size, population deviation of the sizes."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return spread(sizes, F.col("n").cast("double"))


def spread(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("v")).agg(F.count("*").alias("n_clusters"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum("v").alias("total"), F.stddev_pop("v").alias("deviation"))


def dense_labels(labelled: DataFrame, *key: str) -> DataFrame:
    """labelled with dense_label from 0 in the order of the key; ranked on the distinct keys only."""
    ranked = numbered(labelled.select(*key).distinct(), "dense_label", *key)
    return labelled.join(ranked, list(key))


def nearest_by_km(points: DataFrame, lat: float, lon: float, k: int) -> DataFrame:
    """The k points nearest by great circle, ties by point_id, with km."""
    km = haversine_km("lat", "lon", F.lit(lat), F.lit(lon))
    return points.select("point_id", "lat", "lon", km.alias("km")).orderBy("km", "point_id").limit(k)


def farthest_by_km(points: DataFrame, lat: float, lon: float) -> DataFrame:
    km = haversine_km("lat", "lon", F.lit(lat), F.lit(lon))
    rows = points.select("point_id", km.alias("km"))
    return rows.agg(F.max_by("point_id", F.struct("km", -F.col("point_id"))).alias("point_id"), F.max("km").alias("km"))


def sampled(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k points without replacement, the same ones for the same seed: those of least MD5 of seed and id."""
    return points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("point_id").cast("string"))), "point_id").limit(k)
