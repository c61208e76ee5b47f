"""Route statistics and results: tables, one JSON document, workbooks, a map."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.geo import hours, label_colour
from parcelwise.operators.area import dense_labels
from parcelwise.operators.paths import RoadGraph, pair_seconds
from parcelwise.sources.xlsx import workbook

VERSION = 1.0


def first_stops(routed: DataFrame) -> DataFrame:
    """label and the node and point of each route's first stop."""
    return routed.groupBy("label").agg(F.min_by("node_id", "route_series").alias("node_id"), F.min_by("point_id", "route_series").alias("point_id"))


def route_statistics(routed: DataFrame, first_seconds: DataFrame, per_stop: float = 300.0) -> DataFrame:
    """One row for each route, labels from 1, times in hours at two places; the total is the sum of the rounded parts.

    routed: label, point_id, travel_seconds (the same on a route's rows);
    first_seconds: label, first_seconds from the depot to the first stop.
    """
    per = routed.groupBy("label").agg(F.count("*").alias("count_orders"), F.max("travel_seconds").alias("travel"))
    per = per.join(first_seconds.select("label", "first_seconds"), "label", "left")
    travel, delivery = hours("travel"), hours(F.col("count_orders") * float(per_stop))
    return per.select((F.col("label") + 1).alias("label"), "count_orders", travel.alias("travel_time"), hours("first_seconds").alias("time_to_first_point"), delivery.alias("delivery_time"), F.bround(travel + delivery, 2).alias("total_working_time"))


def seconds_to_first(routed: DataFrame, graph: RoadGraph | None, durations: DataFrame | None = None) -> DataFrame:
    """label and first_seconds; routed has label, node_id, point_id, route_series and start_node.

    Drive times come from the graph, or from `durations` if given.
    """
    ends = first_stops(routed).join(routed.groupBy("label").agg(F.first("start_node").alias("start_node")), "label")
    key = ends.select("label", F.least("node_id", "start_node").alias("a"), F.greatest("node_id", "start_node").alias("b"))
    if durations is None:
        timed = key.join(pair_seconds(key.select("a", "b"), graph), ["a", "b"], "left")
    else:
        known = key.join(durations.select("a", "b", "duration"), ["a", "b"], "left")
        timed = known.withColumn("duration", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("duration")))
    return timed.select("label", F.col("duration").alias("first_seconds"))


def result_orders(orders: DataFrame, routed: DataFrame) -> DataFrame:
    """The orders' own columns with label from 1 and route_series, by point_id."""
    return orders.join(routed.select("point_id", (F.col("label") + 1).alias("label"), "route_series"), "point_id")


MOST_ROWS = 1_000_000


def refuse_many(orders: DataFrame, most: int = MOST_ROWS) -> None:
    """Raises where a result has more orders than one document, workbook or map can hold."""
    if (n := orders.count()) > most:
        raise ValueError(f"{n} orders are more than one document holds ({most}); export_tables writes any number")


def result_document(routes: DataFrame, orders: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One row, `document`: {"version", "routes", "orders"} as JSON, for results of up to `most` orders; any more are refused."""
    refuse_many(orders, most)
    listed = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("_row")))).alias("x")).select(F.transform("x", lambda r: r["_row"]).alias("x"))
    a, b = listed(routes, ["label"]), listed(orders, ["point_id"])
    both = a.withColumnRenamed("x", "routes").join(b.withColumnRenamed("x", "orders"))
    return both.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "routes", "orders"), {"ignoreNullFields": "false"}).alias("document"))


def written(path: str, data: bytes) -> str:
    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name, compression=None) as f:
        f.write(data)
    return path


def export_json(routes: DataFrame, orders: DataFrame, folder: str) -> str:
    """result.json.gz in the folder; its path."""
    document = result_document(routes, orders).first()["document"]
    return written(f"{folder.rstrip('/')}/result.json.gz", gzip.compress(document.encode()))


def export_tables(routes: DataFrame, orders: DataFrame, folder: str) -> str:
    """The same result for any size: Parquet tables, orders by label and in route order; the folder."""
    routes.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/routes")
    dealt = orders.repartition("label").sortWithinPartitions("label", "route_series")
    dealt.write.mode("overwrite").partitionBy("label").parquet(f"{folder.rstrip('/')}/orders")
    return folder


def export_workbooks(routes: DataFrame, orders: DataFrame, folder: str) -> str:
    """all_routes.xlsx, all_address.xlsx and route_<label>.xlsx for each label in route order, zipped; the archive's path."""
    refuse_many(orders)
    stats, rows = routes.orderBy("label").toPandas(), orders.orderBy("point_id").toPandas()
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    sheet = lambda df, index: workbook(["", *df.columns] if index else list(df.columns), [[*([i] if index else []), *map(plain, r)] for i, r in enumerate(df.itertuples(index=False))])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("all_routes.xlsx", sheet(stats, True))
        z.writestr("all_address.xlsx", sheet(rows, True))
        for label, own in rows.groupby("label"):
            z.writestr(f"route_{label}.xlsx", sheet(own.sort_values("route_series"), False))
    return written(f"{folder.rstrip('/')}/result.zip", out.getvalue())


def coloured(labelled: DataFrame) -> DataFrame:
    """label and colour of every distinct label, by its rank."""
    ranked = dense_labels(labelled.select("label").distinct(), "label")
    return ranked.select("label", "dense_label", label_colour("dense_label").alias("colour"))


def export_map(points: DataFrame, depots: DataFrame, folder: str) -> str:
    """A page that draws the stops in their labels' colours and the depots over them, with its data as GeoJSON."""
    refuse_many(points)
    rows = points.join(coloured(points), "label").select("point_id", "lat", "lon", "label", "colour").orderBy("point_id").collect()
    feature = lambda lat, lon, **p: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": p}
    found = [feature(r["lat"], r["lon"], label=r["label"], colour=r["colour"]) for r in rows]
    found += [feature(r["lat"], r["lon"], depot=True) for r in depots.collect()]
    middle = [sum(r[k] for r in rows) / max(1, len(rows)) for k in ("lat", "lon")]
    data = json.dumps({"type": "FeatureCollection", "centre": middle, "zoom": 9, "features": found})
    page = f"""<!doctype html><meta charset="utf-8"><title>routes</title><svg id="m" width="100%" height="95vh" xmlns="http://www.w3.org/2000/svg"></svg>
<script id="data" type="application/geo+json">{data}</script>
<script>
const d = JSON.parse(document.getElementById("data").textContent), m = document.getElementById("m"), xy = d.features.map(f => f.geometry.coordinates);
const [x0, x1, y0, y1] = [0, 1].flatMap(i => [Math.min(...xy.map(p => p[i])), Math.max(...xy.map(p => p[i]))]);
m.setAttribute("viewBox", `0 0 1000 1000`);
d.features.forEach((f, i) => {{ const c = document.createElementNS(m.namespaceURI, "circle"), t = document.createElementNS(m.namespaceURI, "title");
  c.setAttribute("cx", 20 + 960 * (xy[i][0] - x0) / (x1 - x0 || 1)); c.setAttribute("cy", 980 - 960 * (xy[i][1] - y0) / (y1 - y0 || 1));
  c.setAttribute("r", f.properties.depot ? 9 : 4); c.setAttribute("fill", f.properties.colour || "#000"); t.textContent = f.properties.depot ? "depot" : f.properties.label; c.append(t); m.append(c); }});
</script>"""
    return written(f"{folder.rstrip('/')}/map.html", page.encode())
