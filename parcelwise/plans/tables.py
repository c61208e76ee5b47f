"""Planning tables derived from the driver's: points from customers, depots from regions, a road grid from nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = """select cast(c_custkey as bigint) as point_id,
 cast(40.0 as double) + cast((c_custkey*7919) % 10007 as double)/cast(10007 as double) as lat,
 cast(-74.0 as double) + cast((c_custkey*104729) % 10009 as double)/cast(10009 as double) as lon,
 cast(c_nationkey as bigint) as label, cast(floor(c_custkey/50) as bigint) as block
from {customer}"""

DEPOTS = """select cast(r_regionkey as int) as warehouse_id,
 cast(40.1 as double) + cast(r_regionkey as double)*cast(0.2 as double) as lat,
 cast(-73.9 as double) + cast((r_regionkey*3)%5 as double)*cast(0.2 as double) as lon
from {region}"""

VERTICES = """with k as (select n_nationkey as i from {nation} where n_nationkey < 20),
 grid as (
  select a.i as road_id, b.i as pos, a.i as r, b.i as c from k a cross join k b
  union all select 20 + b.i, a.i, a.i, b.i from k a cross join k b),
 stub as (
  select 40 + i as road_id, 0 as pos, 19 as r, i*4 as c from k where i < 5
  union all select 40 + i, 1, 20, i*4 from k where i < 5),
 ring as (
  select 45 as road_id, i as pos, case when i in (1,2) then 11 else 10 end as r,
         case when i in (2,3) then 11 else 10 end as c from k where i < 5),
 v as (select * from grid union all select * from stub union all select * from ring)
select cast(road_id as bigint) as road_id, cast(pos as bigint) as pos,
 cast(400000000 + r*526315 as bigint) as lat_e7, cast(-740000000 + c*526315 as bigint) as lon_e7,
 case when road_id = 45 then 'residential' when road_id >= 40 then 'tertiary_link'
  when road_id % 5 = 0 then 'motorway' when road_id % 5 = 1 then 'primary'
  when road_id % 5 = 2 then 'unclassified' when road_id % 5 = 3 then 'secondary' else 'residential' end as highway,
 case when road_id >= 40 and road_id < 45 then 'yes' when road_id = 45 then null
  when road_id % 20 % 4 = 1 and road_id % 20 between 1 and 18 then 'yes'
  when road_id % 4 = 2 then 'no' else null end as oneway,
 case when road_id = 45 then 'roundabout' else null end as junction
from v"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS, customer=load(spark, sf_dir, "customer"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DEPOTS, region=load(spark, sf_dir, "region"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road_id, geometry, highway, oneway, junction."""
    v = spark.sql(VERTICES, nation=load(spark, sf_dir, "nation"))
    line = F.array_sort(F.collect_list(F.struct("pos", (F.col("lon_e7") / 1e7).alias("lon"), (F.col("lat_e7") / 1e7).alias("lat"))))
    out = v.groupBy("road_id", "highway", "oneway", "junction").agg(line.alias("line"))
    return out.select("road_id", F.transform("line", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("geometry"), "highway", "oneway", "junction")
