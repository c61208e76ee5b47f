"""Orders, depots, roads and known durations, each from whatever it is kept in."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.functions.geo import sound_point
from parcelwise.operators.roads import box_filter
from parcelwise.session import numbered, stored
from parcelwise.sources.gpkg import RoadsGpkg
from parcelwise.sources.xlsx import OrdersXlsx

MAP_FILE = "road_network.gpkg"


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """An orders table from XLSX, CSV or Parquet; latitude and longitude are doubles, business_code text, the rest as it is."""
    if path.endswith(".xlsx"):
        spark.dataSource.register(OrdersXlsx)
        rows = spark.read.format("orders_xlsx").load(path)
    elif path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
    else:
        rows = spark.read.parquet(path)
    for name, kind in (("latitude", "double"), ("longitude", "double"), ("business_code", "string")):
        if name in rows.columns:
            rows = rows.withColumn(name, F.col(name).cast(kind))
    if missing := {"latitude", "longitude"} - set(rows.columns):
        raise ValueError(f"orders lack {sorted(missing)}")
    return rows


def points_of(orders: DataFrame) -> DataFrame:
    """orders with point_id, lat and lon; rows without a sound coordinate raise, as they cannot be served."""
    refused = F.raise_error(F.lit("an order has no sound coordinate")).cast("double")
    checked = lambda c: F.when(sound_point("latitude", "longitude"), F.col(c)).otherwise(refused)
    if "point_id" not in orders.columns:
        order = [c for c, kind in orders.dtypes if not kind.startswith(("map", "struct", "array"))]
        orders = numbered(orders, "point_id", *order)
    return orders.withColumn("lat", checked("latitude")).withColumn("lon", checked("longitude"))


def parse_depots(spark: SparkSession, text: str) -> DataFrame:
    """`lat1,lon1 lat2,lon2` as warehouse_id, lat, lon; a malformed or missing coordinate raises."""
    return parsed_depots(spark.createDataFrame([(text,)], "text string"))


def parsed_depots(texts: DataFrame) -> DataFrame:
    token = texts.select(F.posexplode(F.split(F.trim("text"), r"\s+")).alias("warehouse_id", "token"))
    part = F.split("token", ",")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    sound = (F.size(part) == 2) & number(0).isNotNull() & number(1).isNotNull()
    bad = F.raise_error(F.concat(F.lit("no depot coordinate: "), "token")).cast("double")
    return token.select("warehouse_id", F.when(sound, number(0)).otherwise(bad).alias("lat"), F.when(sound, number(1)).otherwise(bad).alias("lon"))


def depot_text(coord: tuple[float, float] | None, coords: str | None) -> str:
    """Several depots win over a single one; neither is an error."""
    if coords and coords.strip():
        return coords
    if coord is None:
        raise ValueError("at least one depot coordinate is needed")
    return f"{coord[0]!r},{coord[1]!r}"


def read_roads(spark: SparkSession, box: tuple[float, float, float, float], path: str | None = None) -> DataFrame:
    """Roads that meet the box, from a GeoPackage (default $MAP_DATA_DIR/road_network.gpkg) or a Parquet table."""
    path = path or os.path.join(os.environ.get("MAP_DATA_DIR", "map_data"), MAP_FILE)
    if path.endswith(".gpkg"):
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)
        spark.dataSource.register(RoadsGpkg)
        roads = spark.read.format("roads_gpkg").option("box", ",".join(map(repr, box))).load(path)
    else:
        roads = spark.read.parquet(path)
    return box_filter(roads, *box)


def map_folder(folder: str, box: tuple[float, float, float, float]) -> str:
    """Where a box's map and its drive times are kept: below folder, under the box at three places."""
    return f"{folder.rstrip('/')}/bbox_key={'_'.join(f'{x:.3f}' for x in box)}"


def cached_map(spark: SparkSession, folder: str, box: tuple[float, float, float, float], build) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) kept below folder for the box; build() makes them where either is missing."""
    paths = [f"{map_folder(folder, box)}/{name}" for name in ("nodes", "edges")]
    try:
        return tuple(spark.read.parquet(p) for p in paths)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    for df, p in zip(build(), paths, strict=True):
        df.write.mode("overwrite").parquet(p)
    return tuple(spark.read.parquet(p) for p in paths)


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, duration) of unordered pairs from CSV (start_id, end_id, duration) or Parquet; of equal pairs the last row counts."""
    if path.rstrip("/").endswith(".csv"):
        rows = spark.read.csv(path, header=True, schema="start_id long, end_id long, duration double")
    else:
        rows = spark.read.parquet(path)
    return last_durations(rows.withColumn("line", F.struct(F.input_file_name(), F.monotonically_increasing_id())))


def last_durations(rows: DataFrame) -> DataFrame:
    pair = rows.where("start_id is not null and end_id is not null").select(F.least("start_id", "end_id").alias("a"), F.greatest("start_id", "end_id").alias("b"), "duration", "line")
    return pair.groupBy("a", "b").agg(F.max_by("duration", "line").alias("duration"))


def kept_durations(spark: SparkSession, path: str) -> DataFrame:
    """What `read_durations` finds at path, no rows where nothing is kept yet."""
    try:
        return read_durations(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "a long, b long, duration double")


def add_durations(spark: SparkSession, path: str, found: DataFrame) -> None:
    """Appends those pairs that the table at path does not hold yet."""
    rows = stored(found.where("duration is not null").select(F.col("a").alias("start_id"), F.col("b").alias("end_id"), "duration"), "durations")
    try:
        rows = rows.join(spark.read.parquet(path), ["start_id", "end_id"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)


def row_series(df: DataFrame, by: str, *order: str):
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))
