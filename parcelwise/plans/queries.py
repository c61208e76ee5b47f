"""The registered queries of the planning engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.operators import area, neighbours, paths, refine, report, roads, tours, zones
from parcelwise.plans import planner, tables
from parcelwise.session import stored
from parcelwise.sources import inputs

BOX = (-73.75, 40.20, -73.40, 40.42)


def network(spark: SparkSession, sf_dir: str) -> planner.Network:
    return planner.build_network(tables.roads(spark, sf_dir))


def snapped(spark: SparkSession, sf_dir: str, net: planner.Network) -> DataFrame:
    return stored(planner.snapped_points(tables.points(spark, sf_dir), net), "snapped")


def seats(spark: SparkSession, sf_dir: str, net: planner.Network) -> DataFrame:
    return planner.snapped_depots(tables.depots(spark, sf_dir), net)


def in_order(stops: DataFrame) -> DataFrame:
    """Routes of the blocks of customers, in the order of their ids."""
    return stops.withColumn("label", F.col("block")).withColumn("route_series", inputs.row_series(stops, "block", "point_id"))


def depot_reach(spark, sf_dir):
    """Customers, mean and greatest drive time of each depot, every customer going to the depot nearest by time."""
    net = network(spark, sf_dir)
    stops, own = snapped(spark, sf_dir, net), seats(spark, sf_dir, net)
    reached = paths.from_sources(own.select(F.col("node_id").alias("source")), net.graph)
    offers = reached.join(own.select("warehouse_id", F.col("node_id").alias("source")), "source").select("warehouse_id", "node_id", F.round("duration", 6).alias("duration"))
    best = offers.groupBy("node_id").agg(F.min(F.struct("duration", "warehouse_id")).alias("best")).select("node_id", "best.*")
    served = stops.join(best, "node_id")
    return served.groupBy("warehouse_id").agg(F.count("*").alias("n_customers"), F.round(F.avg("duration"), 4).alias("mean_seconds"), F.round(F.max("duration"), 4).alias("most_seconds"))


def bbox_extent(spark, sf_dir):
    box = area.bounding_box(tables.points(spark, sf_dir), tables.depots(spark, sf_dir))
    return box.select(*(F.round(c, 6).alias(c) for c in box.columns))


def area_guard(spark, sf_dir):
    box = area.guarded(area.extent(tables.points(spark, sf_dir), tables.depots(spark, sf_dir)))
    return box.select(F.round("lat_km", 6).alias("lat_km"), F.round("lon_km", 6).alias("lon_km"))


def warehouse_parse(spark, sf_dir):
    key = F.col("r_regionkey").cast("string")
    texts = tables.load(spark, sf_dir, "region").select(F.concat(F.lit("  4"), key, F.lit(".5,-73."), key, F.lit("25  41.25,-74.5 ")).alias("text"))
    return inputs.parsed_depots(texts)


def road_nodes_distinct(spark, sf_dir):
    return roads.nodes(tables.roads(spark, sf_dir)).select("node_id", "lat_i", "lon_i")


def road_edges_directed(spark, sf_dir):
    s = roads.segments(tables.roads(spark, sf_dir))
    return s.select("road_id", F.col("pos").cast("long").alias("pos"), F.col("dir").cast("int").alias("dir"), "highway", F.col("u.lat").alias("u_lat"), F.col("u.lon").alias("u_lon"), F.col("v.lat").alias("v_lat"), F.col("v.lon").alias("v_lon"))


def oneway_filter(spark, sf_dir):
    return tables.roads(spark, sf_dir).select("road_id", geo.one_way("oneway", "junction").alias("one_way"))


def bbox_roads(spark, sf_dir):
    return roads.box_filter(tables.roads(spark, sf_dir), *BOX).select("road_id", F.size("geometry").cast("long").alias("n_vertices"))


def _edges(spark, sf_dir):
    lines = tables.roads(spark, sf_dir)
    return roads.edges(lines, stored(roads.nodes(lines), "nodes"))


def edge_duration(spark, sf_dir):
    return _edges(spark, sf_dir).select("start", "end", F.round("distance", 6).alias("distance"), F.round("duration", 6).alias("duration"))


def edge_dedup_last_wins(spark, sf_dir):
    return _edges(spark, sf_dir).select("start", "end", "highway")


def largest_scc(spark, sf_dir):
    return roads.largest_scc(_edges(spark, sf_dir))


def snap_nearest_node(spark, sf_dir):
    net = network(spark, sf_dir)
    return neighbours.snap(tables.points(spark, sf_dir), net.nodes).select("point_id", "node_id", F.round("dist", 9).alias("dist"))


def _asked(spark, sf_dir):
    return tables.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.pmod("o_orderkey", F.lit(997)).alias("b"))


def _known(spark, sf_dir):
    return tables.load(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(997)).alias("start_id"), F.pmod("l_orderkey", F.lit(997)).alias("end_id"), F.col("l_quantity").alias("duration"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("line"))


def pair_key_dedup(spark, sf_dir):
    return neighbours.distinct_pairs(_asked(spark, sf_dir)).select("a", "b", geo.pair_text("a", "b").alias("pair"), geo.shard_of("a", "b").alias("shard"))


def pair_anti_cache(spark, sf_dir):
    return neighbours.distinct_pairs(_asked(spark, sf_dir), inputs.last_durations(_known(spark, sf_dir)))


def preprocess_pairs(spark, sf_dir):
    """The pairs of road nodes whose drive times a plan looks up first: each customer and the 9 nearest, known ones left out."""
    net = network(spark, sf_dir)
    known = tables.load(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(400)).alias("start_id"), F.pmod("l_orderkey", F.lit(400)).alias("end_id"), F.col("l_quantity").alias("duration"), F.struct("l_orderkey", "l_linenumber").alias("line")).where("l_suppkey % 10 = 0")
    return neighbours.neighbour_node_pairs(snapped(spark, sf_dir, net), 10, inputs.last_durations(known))


def duration_cache_scan(spark, sf_dir):
    return inputs.last_durations(_known(spark, sf_dir))


def pair_lookup(spark, sf_dir):
    """Every pair asked for with its known duration or null, repeats kept."""
    found = paths.with_seconds(_asked(spark, sf_dir), inputs.last_durations(_known(spark, sf_dir)))
    return found.select("a", "b", "duration")


def knn_pairs(spark, sf_dir):
    return neighbours.knn_pairs(tables.points(spark, sf_dir), 50).select("point_id", "near_id", F.col("rank").cast("int").alias("rank"))


def nearest_warehouse(spark, sf_dir):
    return neighbours.nearest_depot(area.cluster_means(tables.points(spark, sf_dir)), tables.depots(spark, sf_dir)).select("label", "warehouse_id")


def nearest_point(spark, sf_dir):
    return area.nearest_by_km(tables.points(spark, sf_dir), 40.5, -73.5, 10).select("point_id", F.round("km", 6).alias("km"))


def farthest_point(spark, sf_dir):
    return area.farthest_by_km(tables.points(spark, sf_dir), 40.5, -73.5).select("point_id", F.round("km", 6).alias("km"))


def sampled_points(spark, sf_dir):
    return area.sampled(tables.points(spark, sf_dir), 20, 7).select("point_id")


def cluster_mean(spark, sf_dir):
    return area.cluster_means(tables.points(spark, sf_dir)).select("label", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "n_points")


def weighted_centroid(spark, sf_dir):
    return area.weighted_centroids(tables.points(spark, sf_dir)).select("label", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def cluster_size_stats(spark, sf_dir):
    out = area.size_spread(tables.points(spark, sf_dir))
    return out.select("n_clusters", "least", "greatest", "total", F.round("deviation", 6).alias("deviation"))


def duration_stats(spark, sf_dir):
    by = _edges(spark, sf_dir).groupBy("highway").agg(F.sum("duration").alias("d"))
    out = area.spread(by, F.col("d"))
    return out.select("n_clusters", *(F.round(c, 4).alias(c) for c in ("least", "greatest", "total", "deviation")))


def dense_relabel(spark, sf_dir):
    rows = tables.points(spark, sf_dir).select("point_id", F.pmod("label", F.lit(3)).alias("zone"), "label")
    return area.dense_labels(rows, "zone", "label").select("point_id", "dense_label")


def zone_compose(spark, sf_dir):
    rows = tables.points(spark, sf_dir).select(geo.composed_label("label", F.pmod("label", F.lit(3))).alias("zone_label"))
    return rows.groupBy("zone_label").agg(F.count("*").alias("n"))


def sssp_duration(spark, sf_dir):
    net = network(spark, sf_dir)
    found = paths.from_sources(seats(spark, sf_dir, net).select(F.col("node_id").alias("source")), net.graph)
    return found.select("source", "node_id", F.round("duration", 6).alias("duration"))


def pair_duration(spark, sf_dir):
    """Drive times between customers of successive ids."""
    net = network(spark, sf_dir)
    stops = snapped(spark, sf_dir, net).select("point_id", "node_id")
    after = stops.select((F.col("point_id") - 1).alias("point_id"), F.col("node_id").alias("b"))
    pairs = stops.join(after, "point_id").select(F.col("node_id").alias("a"), "b")
    return paths.pair_seconds(pairs, net.graph).select("a", "b", F.round("duration", 6).alias("duration"))


def _legs(spark, sf_dir, net):
    stops = in_order(snapped(spark, sf_dir, net))
    after = stops.select("block", (F.col("route_series") - 1).alias("route_series"), F.col("node_id").alias("b"))
    pairs = stops.select("block", "route_series", F.col("node_id").alias("a")).join(after, ["block", "route_series"])
    return stops, paths.pair_seconds(pairs.select("a", "b"), net.graph)


def route_leg_sum(spark, sf_dir):
    net = network(spark, sf_dir)
    stops, seconds = _legs(spark, sf_dir, net)
    return tours.leg_seconds(stops, seconds).select("label", F.round("travel_seconds", 4).alias("travel_seconds"), "n_legs")


def first_stop(spark, sf_dir):
    net = network(spark, sf_dir)
    stops = snapped(spark, sf_dir, net)
    by = inputs.row_series(stops, "label", F.desc("point_id"))
    return report.first_stops(stops.withColumn("route_series", by)).select("label", "node_id", "point_id")


def route_statistics(spark, sf_dir):
    """Statistics of the blocks as routes from depot 0, in the order of their ids."""
    net = network(spark, sf_dir)
    stops, seconds = _legs(spark, sf_dir, net)
    travel = tours.leg_seconds(stops, seconds).select("label", F.round("travel_seconds", 3).alias("travel_seconds"))
    start = seats(spark, sf_dir, net).where("warehouse_id = 0").select(F.col("node_id").alias("start_node"))
    rows = stops.join(travel, "label").join(F.broadcast(start))
    first = report.seconds_to_first(rows, net.graph).withColumn("first_seconds", F.round("first_seconds", 3))
    return report.route_statistics(rows, first)


def route_statistics_nearest(spark, sf_dir):
    """Statistics of the blocks as routes from the depot nearest to their mean, in the order of their ids."""
    net = network(spark, sf_dir)
    stops, seconds = _legs(spark, sf_dir, net)
    travel = tours.leg_seconds(stops, seconds).select("label", F.round("travel_seconds", 3).alias("travel_seconds"))
    own = seats(spark, sf_dir, net)
    seat = neighbours.nearest_depot(area.cluster_means(stops), own).join(own.select("warehouse_id", F.col("node_id").alias("start_node")), "warehouse_id")
    rows = stops.join(travel, "label").join(seat.select("label", "start_node", "warehouse_id"), "label")
    first = report.seconds_to_first(rows, net.graph).withColumn("first_seconds", F.round("first_seconds", 3))
    return report.route_statistics(rows, first)


def route_duration_spread(spark, sf_dir):
    """How evenly the blocks' routes are filled: least, greatest and total drive time, and their deviation."""
    net = network(spark, sf_dir)
    stops, seconds = _legs(spark, sf_dir, net)
    out = area.spread(tours.leg_seconds(stops, seconds), F.col("travel_seconds"))
    return out.select("n_clusters", *(F.round(c, 3).alias(c) for c in ("least", "greatest", "total", "deviation")))


def label_color(spark, sf_dir):
    return report.coloured(tables.points(spark, sf_dir))


def coord_quantize(spark, sf_dir):
    return tables.points(spark, sf_dir).select("point_id", geo.quantised("lat").alias("lat_i"), geo.quantised("lon").alias("lon_i"), geo.dequantised(geo.quantised("lat")).alias("lat"))


def haversine(spark, sf_dir):
    km = geo.haversine_km("lat", "lon", F.lit(40.5), F.lit(-73.5))
    return tables.points(spark, sf_dir).select("point_id", F.round(km, 6).alias("km"), F.round(geo.degrees_apart("lat", "lon", F.lit(40.5), F.lit(-73.5)), 9).alias("degrees"))


def intra_cluster_pairs(spark, sf_dir):
    """All pairs of the stops of a route; a route (here: 50 stops) bounds its pairs."""
    pairs = neighbours.pairs_within(tables.points(spark, sf_dir), "block", of="point_id")
    return pairs.groupBy("block").agg(F.count("*").alias("n_pairs"), F.sum(F.col("a") * 31 + F.col("b")).alias("digest"))


def cross_cluster_min(spark, sf_dir):
    """The least drive time between a block's stops and the next block's."""
    net = network(spark, sf_dir)
    rows = snapped(spark, sf_dir, net).select("block", "node_id").distinct()
    after = rows.select((F.col("block") - 1).alias("block"), F.col("node_id").alias("b"))
    pairs = stored(rows.select("block", F.col("node_id").alias("a")).join(after, "block"), "pairs")
    timed = paths.with_seconds(pairs, paths.pair_seconds(pairs.select("a", "b"), net.graph))
    return timed.groupBy("block").agg(F.round(F.min("duration"), 6).alias("least_seconds"))


def points_union_depots(spark, sf_dir):
    bag = area.bag_of_points(tables.points(spark, sf_dir), tables.depots(spark, sf_dir))
    return bag.select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def tour_sequence(spark, sf_dir):
    """The blocks' tours from their nearest depots."""
    net = network(spark, sf_dir)
    stops = snapped(spark, sf_dir, net).withColumn("label", F.col("block"))
    return planner.routed(stops, seats(spark, sf_dir, net), net).select("label", "point_id", "route_series", "travel_seconds")


def tour_check(spark, sf_dir):
    """By block: its tour's stops, first and last place, whether places are a permutation, and whether the drive time is its legs' sum and at most twice that of the spanning tree over start and stops."""
    net = network(spark, sf_dir)
    own = stored(seats(spark, sf_dir, net), "seats")
    done = planner.routed(snapped(spark, sf_dir, net).withColumn("label", F.col("block")), own, net)
    legs = done.select("label", "route_series", "node_id").unionByName(done.groupBy("label").agg(F.lit(0).cast("long").alias("route_series"), F.first("start_node").alias("node_id")))
    after = legs.select("label", (F.col("route_series") - 1).alias("route_series"), F.col("node_id").alias("b"))
    pairs = stored(legs.withColumnRenamed("node_id", "a").join(after, ["label", "route_series"]), "legs")
    driven = paths.with_seconds(pairs, paths.pair_seconds(pairs.select("a", "b"), net.graph)).groupBy("label").agg(F.sum("duration").alias("driven"))
    tree = refine.cluster_trees(legs.withColumn("point_id", F.col("route_series")), net.graph).groupBy("label").agg(F.sum("duration").alias("tree"))
    per = done.groupBy("label").agg(F.count("*").alias("n_stops"), F.min("route_series").alias("first"), F.max("route_series").alias("last"), F.countDistinct("route_series").alias("n_places"), F.max("travel_seconds").alias("travel"))
    per = per.join(driven, "label").join(tree, "label", "left")
    near = F.abs(F.col("driven") - F.col("travel")) < 1e-3
    return per.select("label", "n_stops", "first", "last", (F.col("n_places") == F.col("n_stops")).alias("permutation"), near.alias("legs_add_up"), (F.col("travel") <= 2 * F.coalesce("tree", F.lit(0.0)) + 1e-3).alias("within_two_trees"))


def cluster_mst_weight(spark, sf_dir):
    """Edges and total seconds of the spanning tree of each block."""
    net = network(spark, sf_dir)
    stops = snapped(spark, sf_dir, net).withColumn("label", F.col("block"))
    return refine.cluster_trees(stops, net.graph).groupBy("label").agg(F.count("*").alias("n_edges"), F.round(F.sum("duration"), 3).alias("seconds"))


def cluster_mst(spark, sf_dir):
    net = network(spark, sf_dir)
    stops = snapped(spark, sf_dir, net).withColumn("label", F.col("block"))
    return refine.cluster_trees(stops, net.graph)


def size_limited_cluster(spark, sf_dir):
    """Clusters of about 50 customers in each zone."""
    points = tables.points(spark, sf_dir)
    return _sized(points, zones.plan_zones(points))


def _sized(points, zone):
    region = zone.select("point_id", (F.col("bucket") * 1000 + F.col("zone")).alias("region"))
    return zones.size_clusters(points.join(region, "point_id"), 50, "region")


def zone_cluster(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    return zones.split_zones(points, min(zones.ZONE, max(1, points.count() // 3)))


def _clusters(spark, sf_dir, net, zone=None):
    return planner.clusters(snapped(spark, sf_dir, net), seats(spark, sf_dir, net), net, planner.Settings(), zone)


def duration_limited_cluster(spark, sf_dir):
    """Routes that fit a shift."""
    return _clusters(spark, sf_dir, network(spark, sf_dir))


def _block_stops(spark, sf_dir, net):
    """Routes of the strips of a coarse grid, as a start that refinement can better."""
    stops = snapped(spark, sf_dir, net)
    strip = F.floor((F.col("lat") - 40.0) * 6) * 6 + F.floor((F.col("lon") + 74.0) * 6)
    return stops.withColumn("region", F.floor((F.col("lat") - 40.0) * 2).cast("long")).withColumn("label", strip.cast("long"))


def _refined(spark, sf_dir):
    net = network(spark, sf_dir)
    stops = _block_stops(spark, sf_dir, net).drop("region")
    return refine.refine_clusters(stops.join(zones.stretches(stops), "label"), net.graph, "region")


def refine_clusters(spark, sf_dir):
    return _refined(spark, sf_dir).select("point_id", "label")


def refine_check(spark, sf_dir):
    """Of the refinement: stops, whether each has one label, whether all labels were there before, whether gain and moves belong together."""
    net = network(spark, sf_dir)
    before = _block_stops(spark, sf_dir, net).select("label").distinct().withColumn("known", F.lit(True))
    done = stored(_refined(spark, sf_dir), "refined").join(F.broadcast(before), "label", "left")
    moved = F.col("moves") > 0
    return done.agg(F.count("*").alias("n_stops"), (F.countDistinct("point_id") == F.count("*")).alias("one_label_each"), F.coalesce(F.bool_and(F.coalesce("known", F.lit(False))), F.lit(True)).alias("old_labels"), F.coalesce(F.bool_and((F.col("gain") > 0) == moved), F.lit(True)).alias("moves_gain"))


def cluster_check(spark, sf_dir):
    """Of the clusters by size, the zones and the routes by shift: points, whether each has one label, and whether labels are dense."""
    points = tables.points(spark, sf_dir)
    zone = stored(zones.plan_zones(points), "zones")
    found = {"size": _sized(points, zone).select("point_id", F.struct(F.col("region").alias("a"), F.col("label").alias("b")).alias("part"), F.col("region").alias("whole"), F.col("label").alias("k"))}
    made = _clusters(spark, sf_dir, network(spark, sf_dir), zone)
    found["shift"] = made.select("point_id", F.struct(F.lit(0).cast("long").alias("a"), F.col("label").alias("b")).alias("part"), F.lit(0).cast("long").alias("whole"), F.col("label").alias("k"))
    zoned = zone if points.count() >= 3 * zones.ZONE else zone_cluster(spark, sf_dir)  # from there on both split alike
    found["zone"] = zoned.select("point_id", F.struct(F.col("bucket").alias("a"), F.col("zone").alias("b")).alias("part"), F.col("bucket").alias("whole"), F.col("zone").alias("k"))
    out = None
    for kind, rows in found.items():
        rows = stored(rows, "clusters")
        dense = rows.groupBy("whole").agg((F.countDistinct("k") == F.max("k") + 1).alias("dense")).agg(F.bool_and("dense").alias("dense"))
        row = rows.agg(F.count("*").alias("n_points"), (F.countDistinct("point_id") == F.count("*")).alias("one_label_each")).join(dense).select(F.lit(kind).alias("kind"), "n_points", "one_label_each", "dense")
        out = row if out is None else out.unionByName(row)
    return out


def shared_address_clusters(spark, sf_dir):
    """Clusters of about 50 orders, many at one address: orders, addresses, and whether no address is torn over more clusters than it fills."""
    rows = tables.load(spark, sf_dir, "orders").join(tables.points(spark, sf_dir).withColumnRenamed("point_id", "o_custkey"), "o_custkey").select(F.col("o_orderkey").alias("point_id"), "o_custkey", "lat", "lon")
    made = stored(_sized(rows, zones.plan_zones(rows)), "shared").join(rows.select("point_id", "o_custkey"), "point_id")
    return made.agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_addresses"), (F.countDistinct("point_id") == F.count("*")).alias("one_label_each"))


def result_document(spark, sf_dir):
    """The JSON document of the blocks' tours."""
    net = network(spark, sf_dir)
    stops = snapped(spark, sf_dir, net).withColumn("label", F.col("block"))
    done = planner.routed(stops, seats(spark, sf_dir, net), net)
    stats = report.route_statistics(done, report.seconds_to_first(done, net.graph))
    return report.result_document(stats, report.result_orders(tables.points(spark, sf_dir).select("point_id", "lat", "lon"), done))


def result_counts(spark, sf_dir):
    """What the JSON document of the blocks' tours holds, read back from it."""
    document = result_document(spark, sf_dir)
    held = F.from_json("document", "version double, routes array<struct<label long, count_orders long, delivery_time double>>, orders array<struct<point_id long, label long, route_series long>>")
    d = document.select(held.alias("d")).select("d.*")
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return d.select("version", F.size("routes").cast("long").alias("n_routes"), F.size("orders").cast("long").alias("n_orders"), total(F.col("routes"), lambda r: r["label"] * r["count_orders"]).alias("labels_by_orders"), total(F.col("orders"), lambda o: o["label"]).alias("labels_of_orders"), total(F.col("orders"), lambda o: o["route_series"]).alias("places"))


def queries() -> dict:
    found = (
        depot_reach, bbox_extent, area_guard, warehouse_parse, road_nodes_distinct, road_edges_directed, oneway_filter, bbox_roads, edge_duration, edge_dedup_last_wins,
        largest_scc, snap_nearest_node, pair_key_dedup, pair_anti_cache, duration_cache_scan, pair_lookup, knn_pairs, nearest_warehouse, nearest_point, farthest_point,
        sampled_points, cluster_mean, weighted_centroid, cluster_size_stats, duration_stats, dense_relabel, zone_compose, sssp_duration, pair_duration, route_leg_sum,
        first_stop, route_statistics, route_statistics_nearest, route_duration_spread, label_color, coord_quantize, haversine, intra_cluster_pairs, cross_cluster_min, points_union_depots, tour_sequence, tour_check, cluster_mst, cluster_mst_weight,
        size_limited_cluster, zone_cluster, duration_limited_cluster, cluster_check, shared_address_clusters, refine_clusters, refine_check, result_document, result_counts, preprocess_pairs,
    )
    return {f.__name__: f for f in found}


# ---- SQL

P = tables.POINTS.format(customer="customer")
D = tables.DEPOTS.format(region="region")
V = tables.VERTICES.format(nation="nation")
SPEED = "case highway " + " ".join(f"when '{k}' then {v!r}e0" for k, v in geo.SPEEDS.items()) + " end"


def km_sql(lat1, lon1, lat2, lon2):
    return f"{2 * geo.EARTH_KM!r}e0 * asin(sqrt(least(1e0, pow(sin((radians({lat2}) - radians({lat1})) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2e0), 2e0))))"


def deg_sql(lat1, lon1, lat2, lon2):
    return f"sqrt(pow({lat1} - {lat2}, 2e0) + pow({lon1} - {lon2}, 2e0))"


BASE = f"""p as ({P}), d as ({D}), v as ({V}),
nodes as (select row_number() over (order by min(road_id * 1000 + pos)) - 1 as node_id, lat_e7 as lat_i, lon_e7 as lon_i, lat_e7 / 1e7 as lat, lon_e7 / 1e7 as lon from v group by lat_e7, lon_e7),
pairs as (select road_id, pos, highway, lat_e7 as alat, lon_e7 as alon, lead(lat_e7) over w as blat, lead(lon_e7) over w as blon,
  coalesce(oneway = 'yes', false) or (oneway is null and coalesce(junction = 'roundabout', false)) as one_way from v window w as (partition by road_id order by pos)),
seg as (select road_id, pos, 0 as dir, highway, alat as u_lat, alon as u_lon, blat as v_lat, blon as v_lon from pairs where blat is not null
  union all select road_id, pos, 1, highway, blat, blon, alat, alon from pairs where blat is not null and not one_way),
lastseg as (select u_lat, u_lon, v_lat, v_lon, arg_max(highway, road_id * 10000 + pos * 10 + dir) as highway from seg group by all),
raw as (select a.node_id as s, b.node_id as e, highway, {km_sql("a.lat", "a.lon", "b.lat", "b.lon")} * 1000e0 as distance
  from lastseg join nodes a on a.lat_i = u_lat and a.lon_i = u_lon join nodes b on b.lat_i = v_lat and b.lon_i = v_lon),
edges as (select s, e, highway, distance, distance / ({SPEED} / 3600e0 * 1000e0) as duration from raw),
reach as (select s as x, e as y from edges union select x, e from reach join edges on s = y),
mutual as (select a.x, a.y from reach a join reach b on a.x = b.y and a.y = b.x),
scc as (select y as node_id from mutual where x = (select x from mutual group by x order by count(*) desc, min(y) limit 1)),
net as (select nodes.* from nodes join scc using (node_id)),
inner_edges as (select edges.* from edges where s in (from scc) and e in (from scc)),
snapped as (select point_id, label, block, p.lat, p.lon, arg_min(node_id, {deg_sql("p.lat", "p.lon", "net.lat", "net.lon")}) as node_id, min({deg_sql("p.lat", "p.lon", "net.lat", "net.lon")}) as dist from p cross join net group by all),
seats as (select warehouse_id, arg_min(node_id, {deg_sql("d.lat", "d.lon", "net.lat", "net.lon")}) as node_id from d cross join net group by all)"""


def ways(sources: str) -> str:
    """Shortest drive times from the nodes of a query (x)."""
    return f"""way(x, y, t) using key (x, y) as (select x, x, 0e0 from ({sources})
 union select w.x, n.e, min(w.t + n.duration) from way w join inner_edges n on n.s = w.y left join recurring.way r on r.x = w.x and r.y = n.e
 where w.t + n.duration < coalesce(r.t, 1e18) group by w.x, n.e)"""


def base(select: str, *more: str) -> str:
    return f"with recursive {', '.join([BASE, *more])}\n{select}"


SERIES = "routes as (select *, row_number() over (partition by block order by point_id) as series from snapped), legs as (select block, least(node_id, b) as a, greatest(node_id, b) as b from (select block, node_id, lead(node_id) over (partition by block order by point_id) as b from snapped) where b is not null)"
ASKED = "asked as (select o_custkey as a, o_orderkey % 997 as b from orders)"
KNOWN = "known as (select least(s, e) as a, greatest(s, e) as b, arg_max(q, k) as duration from (select l_partkey % 997 as s, l_orderkey % 997 as e, l_quantity as q, (l_orderkey, l_linenumber, l_quantity) as k from lineitem) group by 1, 2)"


def oracle_sql() -> dict[str, str]:
    box = "select min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as e from (select lat, lon from p union all select lat, lon from d)"
    shard = "((least(a, b) * 31 + greatest(a, b) * 37) % 4294967296) % 16"
    rank = "with p as (%s), l as (select distinct label from p), r as (select label, dense_rank() over (order by label) - 1 as k from l)" % P  # noqa: UP031
    light, full = "(case when k % 2 = 0 then 0.6e0 else 0.35e0 end)", "(case when k % 2 = 0 then 0.65e0 else 0.9e0 end)"
    tones = f"c as (select label, (k * 137.508e0) % 360e0 as h, {light} as li, (1e0 - abs({light} * 2e0 - 1e0)) * {full} as ch from r), m as (select *, ch * (1e0 - abs((h / 60e0) % 2e0 - 1e0)) as x, floor(h / 60e0) as s, li - ch / 2e0 as o from c)"
    tone = lambda order: "lpad(lower(format('{:x}', cast(round_even((case s " + " ".join(f"when {i} then {t}" for i, t in enumerate(order)) + " end + o) * 255e0, 0) as bigint))), 2, '0')"
    colour = " || ".join(tone(x) for x in (("ch", "x", "0e0", "0e0", "x", "ch"), ("x", "ch", "ch", "x", "0e0", "0e0"), ("0e0", "0e0", "x", "ch", "ch", "x")))
    min_lon, min_lat, max_lon, max_lat = BOX
    return {
        "depot_reach": base("select warehouse_id, count(*) as n_customers, round(avg(duration), 4) as mean_seconds, round(max(duration), 4) as most_seconds from (select point_id, arg_min(warehouse_id, (round(t, 6), warehouse_id)) as warehouse_id, min(round(t, 6)) as duration from snapped join way on y = snapped.node_id join seats on x = seats.node_id group by point_id) group by 1", ways("select distinct node_id as x from seats")),
        "bbox_extent": f"with p as ({P}), d as ({D}), x as ({box}) select round(c - 10e0 / (111.32e0 * cos(radians((a + b) / 2e0))), 6) as min_lon, round(a - 10e0 / 111.32e0, 6) as min_lat, round(e + 10e0 / (111.32e0 * cos(radians((a + b) / 2e0))), 6) as max_lon, round(b + 10e0 / 111.32e0, 6) as max_lat from x",
        "area_guard": f"with p as ({P}), d as ({D}), x as ({box}) select round((b - a) * 111.32e0, 6) as lat_km, round((e - c) * 111.32e0 * cos(radians((a + b) / 2e0)), 6) as lon_km from x",
        "warehouse_parse": "select cast(i as int) as warehouse_id, cast(split_part(t, ',', 1) as double) as lat, cast(split_part(t, ',', 2) as double) as lon from (select unnest(['4' || r_regionkey || '.5,-73.' || r_regionkey || '25', '41.25,-74.5']) as t, unnest([0, 1]) as i from region)",
        "road_nodes_distinct": base("select node_id, lat_i, lon_i from nodes"),
        "road_edges_directed": base("select road_id, pos, cast(dir as int) as dir, highway, u_lat, u_lon, v_lat, v_lon from seg"),
        "oneway_filter": base("select distinct road_id, one_way from pairs"),
        "bbox_roads": f"with v as ({V}), s as (select road_id, lat_e7 / 1e7 as y, lon_e7 / 1e7 as x, lead(lat_e7 / 1e7) over w as y2, lead(lon_e7 / 1e7) over w as x2 from v window w as (partition by road_id order by pos)) select road_id, count(*) as n_vertices from s group by road_id having bool_or(x2 is not null and greatest(x, x2) >= {min_lon} and least(x, x2) <= {max_lon} and greatest(y, y2) >= {min_lat} and least(y, y2) <= {max_lat})",
        "edge_duration": base("select s as start, e as end, round(distance, 6) as distance, round(duration, 6) as duration from edges"),
        "edge_dedup_last_wins": base("select s as start, e as end, highway from edges"),
        "largest_scc": base("select node_id from scc"),
        "snap_nearest_node": base("select point_id, node_id, round(dist, 9) as dist from snapped"),
        "pair_key_dedup": f"with {ASKED} select distinct least(a, b) as a, greatest(a, b) as b, least(a, b) || '_' || greatest(a, b) as pair, {shard} as shard from asked where a <> b",
        "pair_anti_cache": f"with {ASKED}, {KNOWN}, q as (select distinct least(a, b) as a, greatest(a, b) as b from asked where a <> b) select a, b from q anti join known using (a, b)",
        "duration_cache_scan": f"with {KNOWN} select a, b, duration from known",
        "pair_lookup": f"with {ASKED}, {KNOWN} select asked.a, asked.b, duration from asked left join known on known.a = least(asked.a, asked.b) and known.b = greatest(asked.a, asked.b)",
        "knn_pairs": f"with p as ({P}) select x.point_id, y.point_id as near_id, cast(row_number() over (partition by x.point_id order by {deg_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')}, y.point_id) as int) as rank from p x join p y on x.point_id <> y.point_id qualify rank <= 49",
        "nearest_warehouse": f"with p as ({P}), d as ({D}), m as (select label, avg(lat) as lat, avg(lon) as lon from p group by label) select label, arg_min(warehouse_id, {deg_sql('m.lat', 'm.lon', 'd.lat', 'd.lon')}) as warehouse_id from m cross join d group by label",
        "nearest_point": f"with p as ({P}) select point_id, round({km_sql('lat', 'lon', '40.5e0', '(-73.5e0)')}, 6) as km from p order by {km_sql('lat', 'lon', '40.5e0', '(-73.5e0)')}, point_id limit 10",
        "farthest_point": f"with p as ({P}) select point_id, round({km_sql('lat', 'lon', '40.5e0', '(-73.5e0)')}, 6) as km from p order by {km_sql('lat', 'lon', '40.5e0', '(-73.5e0)')} desc, point_id limit 1",
        "cluster_mean": f"with p as ({P}) select label, round(avg(lat), 9) as lat, round(avg(lon), 9) as lon, count(*) as n_points from p group by label",
        "weighted_centroid": f"with p as ({P}), m as (select label, avg(lat) as a, avg(lon) as b from p group by label), w as (select label, lat, lon, exp(-{deg_sql('lat', 'lon', 'a', 'b')}) as w from p join m using (label)) select label, round(sum(lat * w) / sum(w), 9) as lat, round(sum(lon * w) / sum(w), 9) as lon from w group by label",
        "cluster_size_stats": f"with p as ({P}), n as (select cast(count(*) as double) as v from p group by label) select count(*) as n_clusters, min(v) as least, max(v) as greatest, sum(v) as total, round(stddev_pop(v), 6) as deviation from n",
        "duration_stats": base("select count(*) as n_clusters, round(min(v), 4) as least, round(max(v), 4) as greatest, round(sum(v), 4) as total, round(stddev_pop(v), 4) as deviation from (select sum(duration) as v from edges group by highway)"),
        "dense_relabel": f"with p as ({P}) select point_id, dense_rank() over (order by label % 3, label) - 1 as dense_label from p",
        "zone_compose": f"with p as ({P}) select label + label % 3 * 10000 as zone_label, count(*) as n from p group by 1",
        "sssp_duration": base("select x as source, y as node_id, round(t, 6) as duration from way", ways("select distinct node_id as x from seats")),
        "pair_duration": base("select a, b, round(t, 6) as duration from (select distinct least(m.node_id, n.node_id) as a, greatest(m.node_id, n.node_id) as b from snapped m join snapped n on n.point_id = m.point_id + 1) join way on x = a and y = b", ways("select distinct node_id as x from snapped")),
        "route_leg_sum": base("select block as label, round(sum(t), 4) as travel_seconds, count(*) as n_legs from legs join way on x = a and y = b group by block", SERIES, ways("select distinct node_id as x from snapped")),
        "first_stop": base("select label, arg_max(node_id, point_id) as node_id, max(point_id) as point_id from snapped group by label"),
        "route_statistics": base("select block + 1 as label, n as count_orders, round_even(travel / 3600e0, 2) as travel_time, round_even(round(t, 3) / 3600e0, 2) as time_to_first_point, round_even(n * 300e0 / 3600e0, 2) as delivery_time, round_even(round_even(travel / 3600e0, 2) + round_even(n * 300e0 / 3600e0, 2), 2) as total_working_time from (select block, count(*) as n, arg_min(node_id, point_id) as f from snapped group by block) join (select block, round(sum(t), 3) as travel from legs join way on x = a and y = b group by block) using (block) cross join (select node_id as depot from seats where warehouse_id = 0) join way on x = least(f, depot) and y = greatest(f, depot)", SERIES, ways("select distinct node_id as x from snapped union select node_id from seats")),
        "label_color": f"{rank}, {tones} select label, k as dense_label, '#' || {colour} as colour from m join r using (label)",
        "coord_quantize": f"with p as ({P}) select point_id, cast(round_even(lat * 1e7, 0) as bigint) as lat_i, cast(round_even(lon * 1e7, 0) as bigint) as lon_i, round_even(lat * 1e7, 0) / 1e7 as lat from p",
        "haversine": f"with p as ({P}) select point_id, round({km_sql('lat', 'lon', '40.5e0', '(-73.5e0)')}, 6) as km, round({deg_sql('lat', 'lon', '40.5e0', '(-73.5e0)')}, 9) as degrees from p",
        "intra_cluster_pairs": f"with p as ({P}) select block, count(*) as n_pairs, cast(sum(a.point_id * 31 + b.point_id) as bigint) as digest from p a join p b using (block) where a.point_id < b.point_id group by block",
        "cross_cluster_min": base("select m.block, round(min(t), 6) as least_seconds from (select distinct block, node_id from snapped) m join (select distinct block, node_id from snapped) n on n.block = m.block + 1 join way on x = least(m.node_id, n.node_id) and y = greatest(m.node_id, n.node_id) group by m.block", ways("select distinct node_id as x from snapped")),
        "sampled_points": f"with p as ({P}) select point_id from p order by md5('7:' || point_id), point_id limit 20",
        "preprocess_pairs": base("select a, b from (select distinct least(m.node_id, n.node_id) as a, greatest(m.node_id, n.node_id) as b from near join snapped m on m.point_id = near.point_id join snapped n on n.point_id = near.near_id where m.node_id <> n.node_id) anti join known using (a, b)", f"near as (select x.point_id, y.point_id as near_id from snapped x join snapped y on x.point_id <> y.point_id qualify row_number() over (partition by x.point_id order by {deg_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')}, y.point_id) <= 9)", "known as (select distinct least(l_partkey % 400, l_orderkey % 400) as a, greatest(l_partkey % 400, l_orderkey % 400) as b from lineitem where l_suppkey % 10 = 0)"),
        "route_statistics_nearest": base(f"select block + 1 as label, n as count_orders, round_even(travel / 3600e0, 2) as travel_time, round_even(round(t, 3) / 3600e0, 2) as time_to_first_point, round_even(n * 300e0 / 3600e0, 2) as delivery_time, round_even(round_even(travel / 3600e0, 2) + round_even(n * 300e0 / 3600e0, 2), 2) as total_working_time from (select block, count(*) as n, arg_min(node_id, point_id) as f from snapped group by block) join (select block, round(sum(t), 3) as travel from legs join way on x = a and y = b group by block) using (block) join (select block, arg_min(seats.node_id, ({deg_sql('m.lat', 'm.lon', 'd.lat', 'd.lon')}, d.warehouse_id)) as depot from (select block, avg(lat) as lat, avg(lon) as lon from snapped group by block) m cross join d join seats on seats.warehouse_id = d.warehouse_id group by block) using (block) join way on x = least(f, depot) and y = greatest(f, depot)", SERIES, ways("select distinct node_id as x from snapped union select node_id from seats")),
        "route_duration_spread": base("select count(*) as n_clusters, round(min(v), 3) as least, round(max(v), 3) as greatest, round(sum(v), 3) as total, round(stddev_pop(v), 3) as deviation from (select sum(t) as v from legs join way on x = a and y = b group by block)", SERIES, ways("select distinct node_id as x from snapped")),
        "tour_check": base("select block as label, count(*) as n_stops, cast(1 as bigint) as first, count(*) as last, true as permutation, true as legs_add_up, true as within_two_trees from snapped group by block"),
        "cluster_mst_weight": base("select block as label, count(*) as n_edges, round(sum(t), 3) as seconds from tree where t > 0 group by block", ways("select distinct node_id as x from snapped"), "own as (select distinct block, node_id from snapped)", "link as (select m.block, m.node_id as a, n.node_id as b, t from own m join own n on n.block = m.block and n.node_id <> m.node_id join way on x = least(m.node_id, n.node_id) and y = greatest(m.node_id, n.node_id))", """tree(block, node_id, t) using key (block, node_id) as (select block, min(node_id), 0e0 from own group by block
 union select link.block, arg_min(link.b, (link.t, link.b)), min(link.t) from tree once join recurring.tree r on r.block = once.block join link on link.block = r.block and link.a = r.node_id
   left join recurring.tree q on q.block = link.block and q.node_id = link.b where q.node_id is null group by link.block)"""),
        "cluster_check": f"with p as ({P}) select kind, count(*) as n_points, true as one_label_each, true as dense from p cross join (select unnest(['size', 'shift', 'zone']) as kind) group by kind",
        "shared_address_clusters": f"with p as ({P}) select count(*) as n_orders, count(distinct o_custkey) as n_addresses, true as one_label_each from orders join p on o_custkey = point_id",
        "refine_check": f"with p as ({P}) select count(*) as n_stops, true as one_label_each, true as old_labels, true as moves_gain from p",
        "result_counts": f"with p as ({P}), b as (select block, count(*) as n from p group by block) select cast(1 as double) as version, count(*) as n_routes, cast(sum(n) as bigint) as n_orders, cast(sum((block + 1) * n) as bigint) as labels_by_orders, cast(sum((block + 1) * n) as bigint) as labels_of_orders, cast(sum(n * (n + 1) // 2) as bigint) as places from b",
        "points_union_depots": f"with p as ({P}), d as ({D}) select round(lat, 9) as lat, round(lon, 9) as lon from (select lat, lon from p union all select lat, lon from d)",
    }
