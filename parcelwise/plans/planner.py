"""The whole plan: orders and depots in, routes with statistics out; also the command line."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators import area, neighbours, paths, refine, report, roads, tours, zones
from parcelwise.operators.paths import RoadGraph
from parcelwise.session import released, stored
from parcelwise.sources import inputs


@dataclass(frozen=True)
class Settings:
    """`durations` names a table of drive times that is read first and added to; `neighbours` are the near stops of which
    each stop's drive times go there at once."""

    per_stop: float = 300.0
    shift: float = 36000.0
    default_kmh: float | None = None
    patience: int = 3
    most_rounds: int = 100
    seed: int = 0
    neighbours: int = 50
    durations: str | None = None


@dataclass
class Network:
    """Nodes and edges of the largest strongly connected component, and its graph, collected when it is first asked for."""

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def graph(self) -> RoadGraph:
        return RoadGraph.collect(self.nodes, self.edges)


def road_tables(road_lines: DataFrame, default_kmh: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the largest strongly connected component."""
    net = build_network(road_lines, default_kmh)
    return net.nodes, net.edges


def build_network(road_lines: DataFrame, default_kmh: float | None = None) -> Network:
    """Nodes and edges are stored once; the component is found on the graph's arrays, which a plan needs anyway."""
    nodes = stored(roads.nodes(road_lines), "nodes")
    edges = stored(roads.edges(road_lines, nodes, default_kmh), "edges")
    graph = RoadGraph.collect(nodes, edges).largest()
    inner = graph.nodes(road_lines.sparkSession)
    net = Network(nodes.join(inner, "node_id", "left_semi"), roads.inside(edges, inner))
    net.graph = graph
    return net


def cached_network(spark: SparkSession, folder: str, box: tuple[float, float, float, float], read_lines, default_kmh: float | None = None) -> Network:
    """The network kept below folder for the box, made from read_lines() where it is missing."""
    return Network(*inputs.cached_map(spark, folder, box, lambda: road_tables(read_lines(), default_kmh)))


def snapped_points(points: DataFrame, net: Network) -> DataFrame:
    """points with node_id."""
    return points.join(neighbours.snap(points, net.nodes).select("point_id", "node_id"), "point_id")


def snapped_depots(depots: DataFrame, net: Network) -> DataFrame:
    found = neighbours.snap(depots.select(F.col("warehouse_id").cast("long").alias("point_id"), "lat", "lon"), net.nodes)
    return depots.join(found.select(F.col("point_id").cast("int").alias("warehouse_id"), "node_id"), "warehouse_id")


def known_times(pairs: DataFrame, net: Network, path: str) -> DataFrame:
    """The table of durations at path, after the pairs (a, b) that it lacked were searched and added."""
    spark = pairs.sparkSession
    todo = stored(neighbours.distinct_pairs(pairs, inputs.kept_durations(spark, path)), "asked")
    if not todo.isEmpty():
        inputs.add_durations(spark, path, paths.pair_seconds(todo, net.graph))
    return inputs.kept_durations(spark, path)


def preprocess(stops: DataFrame, net: Network, path: str, k: int = 50) -> DataFrame:
    """The table of durations at path, holding those between each stop and its k - 1 nearest ones."""
    return known_times(neighbours.neighbour_node_pairs(stops, k), net, path)


def zone_times(stops: DataFrame, zone: DataFrame, depots: DataFrame, net: Network, path: str) -> DataFrame:
    """The table of durations at path, holding all pairs of road nodes of each zone's stops and the depots."""
    ends = F.broadcast(depots.select(F.collect_set("node_id").alias("depot_nodes")))  # as few as the depots
    own = stops.select("point_id", "node_id").join(zone, "point_id").select("bucket", "zone", "node_id")
    seats = own.select("bucket", "zone").distinct().join(ends).select("bucket", "zone", F.explode("depot_nodes").alias("node_id"))
    return known_times(neighbours.pairs_within(own.unionByName(seats), "bucket", "zone").select("a", "b"), net, path)


def routed(stops: DataFrame, depots: DataFrame, net: Network, durations: DataFrame | None = None) -> DataFrame:
    """stops (point_id, lat, lon, node_id, label) in order: with start_node of the nearest depot, route_series, travel_seconds."""
    seat = neighbours.nearest_depot(area.cluster_means(stops), depots)
    start = seat.join(depots.select("warehouse_id", F.col("node_id").alias("start_node")), "warehouse_id").select("label", "start_node")
    rows = stored(stops.select("point_id", "lat", "lon", "node_id", "label").join(start, "label"), "stops")
    series = tours.sequence_routes(rows, None if durations is not None else net.graph, durations)
    return stored(rows.join(series, ["label", "point_id"]), "routed")


def clusters(points: DataFrame, depots: DataFrame, net: Network, settings: Settings, zone: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """point_id, label, bucket and zone of every point: one zone, or many side by side."""
    zone = zones.plan_zones(points, settings.seed) if zone is None else zone
    seats = [(r["lat"], r["lon"], r["node_id"]) for r in depots.orderBy("warehouse_id").collect()]
    graph = None if durations is not None else net.graph
    made = zones.shift_clusters(points, zone, graph, seats, settings.per_stop, settings.shift, settings.patience, settings.most_rounds, settings.seed, durations)
    return stored(made.select("point_id", "label", "bucket", "zone"), "clusters")


def refined(stops: DataFrame, net: Network, path: str | None = None) -> DataFrame:
    """point_id and label of stops (point_id, lat, lon, node_id, label, bucket, zone) after refinement in two passes.

    First each zone is refined, then stretches along the curve whose borders lie inside
    the zones', so that stops also move between zones; a single zone needs no second pass.
    """
    regions = stops.withColumn("region", F.col("bucket") * 1_000_000 + F.col("zone"))
    several = regions.select("region").distinct().limit(2).count() > 1
    for shifted in (False, True)[: 1 + several]:
        durations = None
        if shifted:
            regions = stops.join(zones.stretches(stops, shifted=True), "label")
        if path:
            durations = known_times(neighbours.pairs_within(regions, "region").select("a", "b"), net, path)
        better = stored(refine.refine_clusters(regions, None if path else net.graph, "region", durations), "refined")
        stops = stops.drop("label").join(better.select("point_id", "label"), "point_id")
    return stops.select("point_id", "label")


def plan(orders: DataFrame, depots: DataFrame, road_lines: DataFrame | None, settings: Settings = Settings(), net: Network | None = None) -> tuple[DataFrame, DataFrame]:
    """(route statistics, orders with label and route_series).

    With settings.durations no pair in that table is searched again, and a second plan of
    the same orders searches none. A network at hand takes the place of road_lines.
    """
    points = stored(inputs.points_of(orders), "points")
    net = net or build_network(road_lines, settings.default_kmh)
    stops = stored(snapped_points(points.select("point_id", "lat", "lon"), net), "snapped")
    seats = stored(snapped_depots(depots, net), "depots")
    zone, times = stored(zones.plan_zones(stops, settings.seed), "zones"), None
    if settings.durations:
        preprocess(stops, net, settings.durations, settings.neighbours)
        times = zone_times(stops, zone, seats, net, settings.durations)
    made = clusters(stops, seats, net, settings, zone, times)
    better = refined(stops.join(made, "point_id"), net, settings.durations)
    labelled = stored(stops.join(better, "point_id"), "labelled")
    if settings.durations:  # a route may hold stops of two zones by now
        ends = F.broadcast(seats.select(F.collect_set("node_id").alias("nodes")))
        own = labelled.select("label", "node_id").unionByName(labelled.select("label").distinct().join(ends).select("label", F.explode("nodes").alias("node_id")))
        times = known_times(neighbours.pairs_within(own, "label").select("a", "b"), net, settings.durations)
    done = routed(labelled, seats, net, times)
    stats = report.route_statistics(done, report.seconds_to_first(done, None if settings.durations else net.graph, times), settings.per_stop)
    return stats, report.result_orders(points.drop("lat", "lon"), done)


def mapped(stats: DataFrame, rows: DataFrame, folder: str, depots: DataFrame) -> str:
    points = rows.select("point_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "label")
    return report.export_map(points, depots, folder)


#: By the name of a format, what writes (statistics, orders) to a folder and tells the path.
EXPORTS = {
    "json": lambda stats, rows, folder, depots: report.export_json(stats, rows, folder),
    "map": mapped,
    "tables": lambda stats, rows, folder, depots: report.export_tables(stats, rows, folder),
    "workbooks": lambda stats, rows, folder, depots: report.export_workbooks(stats, rows, folder),
}


def main(args: list[str] | None = None) -> int:
    """Plans a file of orders and prints <done>path</done>, or <error>message</error>."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--warehouse-coord", nargs=2, type=float, metavar=("LAT", "LON"))
    p.add_argument("--warehouse-coords", help='"lat1,lon1 lat2,lon2"')
    p.add_argument("--orders", required=True, help="XLSX, CSV or Parquet")
    p.add_argument("--roads", help="GeoPackage or Parquet; default $MAP_DATA_DIR/road_network.gpkg")
    p.add_argument("--per-delivery-duration", type=int, default=300)
    p.add_argument("--work-duration", type=int, default=36000)
    p.add_argument("--default-kmh", type=float, help="speed of road classes that are not known; without it they are refused")
    p.add_argument("--patience", type=int, default=3, help="rounds of clustering without a better labelling that end it")
    p.add_argument("--rounds", type=int, default=100, help="most rounds of clustering")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--cache", help="folder that keeps the road network and the drive times of each area for later plans")
    p.add_argument("--format", choices=sorted(EXPORTS), default="json")
    p.add_argument("--output", default="output")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("parcelwise").getOrCreate()
    try:
        depots = inputs.parse_depots(spark, inputs.depot_text(a.warehouse_coord, a.warehouse_coords))
        with released(spark):
            orders = inputs.points_of(inputs.read_orders(spark, a.orders))
            box = tuple(area.bounding_box(orders, depots).first())
            lines = lambda: inputs.read_roads(spark, box, a.roads)
            kept = inputs.map_folder(a.cache, box) if a.cache else None
            net = cached_network(spark, a.cache, box, lines, a.default_kmh) if a.cache else build_network(lines(), a.default_kmh)
            settings = Settings(a.per_delivery_duration, a.work_duration, a.default_kmh, a.patience, a.rounds, a.seed, durations=kept and f"{kept}/durations")
            stats, rows = plan(orders, depots, None, settings, net)
            print(f"<done>{EXPORTS[a.format](stats, rows, a.output, depots)}</done>")
        return 0
    except Exception as e:  # the caller reads the outcome from the last line
        print(f"<error>{e}</error>")
        return 1


if __name__ == "__main__":
    sys.exit(main())
