"""Operators of the planning engine against brute force and on the road fixture."""

import heapq
import math
import random
import time
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.operators import area, clusters, neighbours, paths, refine, roads, tours, zones
from parcelwise.operators.matching import perfect_matching
from parcelwise.plans import planner, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net(spark):
    return planner.build_network(tables.roads(spark, SF))


def road(i, line, highway="residential", oneway=None, junction=None):
    return i, [(float(x), float(y)) for x, y in line], highway, oneway, junction


ROADS = "road_id long, geometry array<struct<lon double, lat double>>, highway string, oneway string, junction string"

# ---- expressions


def test_halves_go_to_even(spark):
    rows = spark.createDataFrame([(0.00000005,), (0.00000015,), (0.00000025,), (-0.00000015,)], "x double")
    assert [r[0] for r in rows.select(geo.quantised("x")).collect()] == [round(x * 1e7) for x in (0.00000005, 0.00000015, 0.00000025, -0.00000015)]


def test_one_way_values(spark):
    rows = spark.createDataFrame([("yes", None), ("no", None), ("-1", None), (None, "roundabout"), ("no", "roundabout"), (None, None), (None, "circular")], "o string, j string")
    assert [r[0] for r in rows.select(geo.one_way("o", "j")).collect()] == [True, False, False, True, False, False, False]


def test_unknown_class(spark):
    lines = spark.createDataFrame([road(1, [(0, 0), (0, 1)], "footway")], ROADS)
    nodes = roads.nodes(lines)
    with pytest.raises(Exception, match="unknown road class footway"):
        roads.edges(lines, nodes).collect()
    assert {round(r.distance / r.duration * 3.6) for r in roads.edges(lines, nodes, 20.0).collect()} == {20}


def test_colours(spark):
    import colorsys

    rows = spark.range(40).select("id", geo.label_colour("id").alias("c")).collect()
    for r in rows:
        rgb = colorsys.hls_to_rgb(r.id * 137.508 % 360 / 360, 0.35 if r.id % 2 else 0.6, 0.9 if r.id % 2 else 0.65)
        assert all(abs(int(r.c[1 + 2 * i : 3 + 2 * i], 16) - 255 * v) <= 0.51 for i, v in enumerate(rgb))


def test_guard_and_box(spark):
    depots = spark.createDataFrame([(40.0, -74.0)], "lat double, lon double")
    near, far = (spark.createDataFrame([(40.0 + d, -74.0)], "lat double, lon double") for d in (2.69, 2.7))
    box = area.bounding_box(near, depots).first()
    assert box.min_lat == pytest.approx(40 - 10 / 111.32) and box.max_lon == pytest.approx(-74 + 10 / (111.32 * math.cos(math.radians(41.345))))
    with pytest.raises(Exception, match="spans over 300 km"):
        area.bounding_box(far, depots).collect()


# ---- roads


def test_fixture_counts(spark, net):
    lines = tables.roads(spark, SF)
    nodes = roads.nodes(lines)
    assert nodes.count() == 405 and roads.segments(lines).count() == 1339 and roads.edges(lines, nodes).count() == 1335
    assert sorted(r.node_id for r in nodes.collect()) == list(range(405))
    assert net.nodes.count() == 400 and net.edges.count() == 1330


def test_last_road_wins_and_quantised_vertices_meet(spark):
    lines = spark.createDataFrame([road(1, [(0, 0), (1, 0)], "primary", "yes"), road(2, [(1.00000001, 0), (0, 0), (0, 0)], "motorway")], ROADS)
    nodes = roads.nodes(lines)
    got = {(r.start, r.end): r.highway for r in roads.edges(lines, nodes).collect()}
    assert got == {(0, 1): "motorway", (1, 0): "motorway", (0, 0): "motorway"}


def test_box_filter(spark):
    lines = [road(1, [(0, 0), (10, 10)]), road(2, [(0, 5), (4, 10)]), road(3, [(5, 5), (5.1, 5.1)]), road(4, [(6, -5), (6, 20)]), road(5, [(4, 6.0001), (6, 6.0001)]), road(6, [(4, 6), (6, 6)]), road(7, [(0, 0), (20, 0), (20, 20), (0, 20)])]
    got = roads.box_filter(spark.createDataFrame(lines, ROADS), 4, 4, 6, 6)
    assert sorted(r.road_id for r in got.collect()) == [1, 3, 4, 6]


def test_largest_component_against_reachability():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randrange(1, 14)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 30))]
        reach = {x: {x} for p in pairs for x in p}
        for _ in range(n):
            for a, b in pairs:
                reach[a] |= reach[b]
            for a in reach:
                for b in list(reach[a]):
                    reach[a] |= reach[b]
        parts = {frozenset(b for b in reach[a] if a in reach[b]) for a in reach}
        want = min(parts, key=lambda p: (-len(p), min(p)))
        got = roads.largest_component(*(np.array(x) for x in zip(*pairs, strict=True)))
        assert sorted(got.tolist()) == sorted(want)


# ---- neighbours


@pytest.mark.parametrize("k", [1, 3, 60])
def test_nearest_equals_brute_force(spark, k):
    rng = random.Random(k)
    xy = [(rng.random(), rng.random()) for _ in range(120)] + [(0.5, 0.5)] * 90 + [(9.0, 9.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)], "id long, lat double, lon double")
    got = neighbours.nearest(rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "cand_id"), k, True).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.cand_id))
    for i, (x, y) in enumerate(xy):
        want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, (a, b) in enumerate(xy) if j != i)[:k]
        assert [j for _, j in sorted(by[i])] == [j for _, j in want]


def test_nearest_in_a_town_with_an_outlier(spark):
    """The work does not follow the average density: a town beside an empty area costs what an even one does."""
    def took(xy):
        rows = spark.createDataFrame([(i, *p) for i, p in enumerate(xy.tolist())], "point_id long, lat double, lon double")
        began = time.perf_counter()
        n = neighbours.knn_pairs(rows, 10).count()
        assert n == 9 * len(xy)
        return time.perf_counter() - began

    rng = np.random.default_rng(0)
    even, town = rng.random((16_000, 2)), np.vstack([rng.random((15_999, 2)) * 1e-3, [[1.0, 1.0]]])
    took(even[:500])
    assert took(town) < 2 * took(even) + 1


def test_nearest_across_leaves(spark):
    """Towns of very different density, places on a line, many equal distances: as brute force says."""
    rng = random.Random(3)
    xy = [(rng.random() * 1e-4, rng.random() * 1e-4) for _ in range(300)] + [(40 + rng.random(), -70 + rng.random()) for _ in range(200)]
    xy += [(10.0, x / 10) for x in range(150)] + [(x, y) for x in range(12) for y in range(12)] + [(-89.9, 179.9)]
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, lat double, lon double")
    for k, others in ((1, False), (5, True)):
        got = neighbours.nearest(rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "cand_id"), k, others).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((r["rank"], r.cand_id))
        for i, (x, y) in enumerate(xy):
            want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, (a, b) in enumerate(xy) if not others or j != i)[:k]
            assert [j for _, j in sorted(by[i])] == [j for _, j in want]


def test_neighbour_node_pairs(spark, net):
    stops = planner.snapped_points(tables.points(spark, SF), net)
    at = {r.point_id: (r.lat, r.lon, r.node_id) for r in stops.collect()}
    want = set()
    for i, (x, y, node) in at.items():
        near = sorted((math.hypot(x - a, y - b), j) for j, (a, b, _) in at.items() if j != i)[:5]
        want |= {tuple(sorted((node, at[j][2]))) for _, j in near if at[j][2] != node}
    known = spark.createDataFrame([sorted(want)[0]], "a long, b long")
    got = [tuple(r) for r in neighbours.neighbour_node_pairs(stops, 6, known).collect()]
    assert len(got) == len(set(got)) and set(got) == want - {sorted(want)[0]}


def test_curve_and_vertices(spark):
    rows = spark.createDataFrame([(0, 1.5, -2.5), (1, -90.0, -180.0), (2, 90.0, 180.0), (3, 40.0, -74.0)], "id long, lat double, lon double")
    for r in rows.select("*", geo.curve_place("lat", "lon").alias("place"), geo.vertex("lat", "lon").alias("v")).collect():
        row, column = (math.floor((x + s) / (2 * s) * ((1 << 30) - 1)) for x, s in ((r.lat, 90.0), (r.lon, 180.0)))
        assert r.place == sum((row >> b & 1) << (2 * b + 1) | (column >> b & 1) << (2 * b) for b in range(30))
        assert (r.v.lat, r.v.lon) == (r.lat, r.lon)


def test_node_coordinates(spark, net):
    ids = net.graph.ids[:3].tolist()
    wanted = spark.createDataFrame([(ids[0], "x"), (ids[2], "y"), (-1, "z")], "node_id long, tag string")
    got = {r.tag: (r.lat, r.lon) for r in roads.node_coordinates(net.nodes, wanted).collect()}
    assert got == {"x": (net.graph.lat[0], net.graph.lon[0]), "y": (net.graph.lat[2], net.graph.lon[2]), "z": (None, None)}


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, lat double, lon double")
    some = spark.createDataFrame([(1, 0.0, 0.0)], "cand_id long, lat double, lon double")
    assert neighbours.nearest(none, some, 1).count() == 0
    assert neighbours.nearest(some.withColumnRenamed("cand_id", "query_id"), none.withColumnRenamed("query_id", "cand_id"), 1).count() == 0


def test_nearest_depot_either_way(spark):
    rng = random.Random(8)
    depots = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(30)] + [(30, 0.5, 0.5), (31, 0.5, 0.5)], "warehouse_id int, lat double, lon double")
    centres = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(40)] + [(40, 0.5, 0.5)], "label long, lat double, lon double")
    few, many = ({r.label: r.warehouse_id for r in neighbours.nearest_depot(centres, depots, n).collect()} for n in (1000, 10))
    assert few == many and few[40] == 30 and len(few) == 41


def test_large_graphs_are_refused(spark):
    with pytest.raises(ValueError, match="smaller area"):
        roads.refuse_large(spark.range(3), 2)


# ---- drive times


def plain_seconds(graph, source):
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        at = graph.place(u)
        for k in range(graph.first[at], graph.first[at + 1]):
            v, new = int(graph.ids[graph.to[k]]), d + float(graph.seconds[k])
            if new < best.get(v, math.inf):
                best[v] = new
                heapq.heappush(heap, (new, v))
    return best


def test_pair_seconds(spark, net):
    ids = net.graph.ids.tolist()
    pairs = [(ids[3], ids[200]), (ids[200], ids[3]), (ids[7], ids[7]), (ids[9], ids[10]), (ids[9], ids[300]), (None, ids[2])]
    df = spark.createDataFrame(pairs, "a long, b long")
    known = spark.createDataFrame([(ids[9], ids[10], 1.5)], "a long, b long, duration double")
    got = {(r.a, r.b): r.duration for r in paths.pair_seconds(df, net.graph, known).collect()}
    assert got[ids[9], ids[10]] == 1.5 and got[ids[7], ids[7]] == 0.0 and len(got) == 4
    assert got[ids[3], ids[200]] == pytest.approx(plain_seconds(net.graph, ids[3])[ids[200]])
    both = {(r.a, r.b): r.duration for r in paths.pair_seconds(df, net.graph, directed=True).collect()}
    assert both[ids[200], ids[3]] == pytest.approx(plain_seconds(net.graph, ids[200])[ids[3]])
    slow = {(r.a, r.b): r.duration for r in paths.pair_seconds(df, net.graph, heuristic_kmh=40.0).collect()}
    assert all(slow[p] >= got[p] - 1e-9 for p in slow if p != (ids[9], ids[10]))
    asked = paths.with_seconds(df, paths.pair_seconds(df, net.graph, known))
    assert asked.count() == len(pairs) and asked.where("a is null").first().duration is None


def test_unreachable_is_null(spark):
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(3)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 5.0)], "start long, end long, duration double")
    graph = paths.RoadGraph.collect(nodes, edges)
    got = {(r.a, r.b): r.duration for r in paths.pair_seconds(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), graph).collect()}
    assert got == {(0, 1): 5.0, (1, 2): None}


# ---- tours


def test_matching_is_optimal():
    rng = np.random.default_rng(0)
    for t in range(150):
        n = 2 * int(rng.integers(1, 5))
        cost = np.round(rng.integers(1, 9, (n, n)) if t % 2 else rng.random((n, n)) * 1000, 3).astype(float)
        cost = cost + cost.T

        def least(left):
            return min((cost[left[0], j] + least([x for x in left[1:] if x != j]) for j in left[1:]), default=0.0)

        got = perfect_matching(cost)
        assert sorted(x for p in got for x in p) == list(range(n)) and sum(cost[p] for p in got) == pytest.approx(least(list(range(n))))


def times_of(xy):
    return paths.PairTimes(np.arange(len(xy)), np.linalg.norm(xy[:, None] - xy[None], axis=2) * 1000)


def test_circuits_are_within_half_of_the_best():
    rng = np.random.default_rng(1)
    for n in (3, 5, 7, 8):
        xy = rng.random((n, 2))
        cost = times_of(xy).seconds
        length = lambda o: sum(cost[a, b] for a, b in zip(o, [*o[1:], o[0]], strict=True))  # noqa: B023, E731
        got = tours.circuit(cost, 2)
        assert got[0] == 2 and sorted(got) == list(range(n))
        assert length(got) <= 1.5 * min(length([0, *p]) for p in permutations(range(1, n))) + 1e-9


def test_tour_branches():
    t = times_of(np.array([[0.0, 0], [0, 1], [0, 2], [0, 3]]))
    assert tours.tour([], None, t) == (0.0, []) and tours.tour([1], None, t) == (0.0, [0])
    assert tours.tour([2], 0, t) == (2000.0, [0])
    assert tours.tour([1, 1, 1], None, t) == (0.0, [0, 1, 2])
    assert tours.tour([3, 1, 3], 0, t) == (5000.0, [0, 2, 1])  # two nodes keep their order, whatever the start
    for start in (0, None):
        seconds, places = tours.tour([3, 1, 2, 1], start, t)
        assert sorted(places) == [0, 1, 2, 3] and places[3] == places[1] + 1
    assert tours.tour([3, 1, 2], 0, t)[0] <= 5000
    seconds, places = tours.tour([0, 3, 1, 2], 0, t)  # the start is a stop, and node 0
    assert places[0] == 0 and sorted(places) == [0, 1, 2, 3]
    assert seconds == pytest.approx(tours.route_seconds([0, 3, 1, 2], places, 0, t))


def test_spanning_tree_is_least():
    rng = np.random.default_rng(3)
    cost = rng.random((6, 6))
    cost = cost + cost.T
    tree = tours.spanning_tree(cost)

    def connected(edges):
        seen = {0}
        for _ in range(6):
            seen |= {x for a, b in edges if a in seen or b in seen for x in (a, b)}
        return len(seen) == 6

    best = min(sum(cost[e] for e in es) for es in combinations(list(combinations(range(6), 2)), 5) if connected(es))
    assert sum(w for _, _, w in tree) == pytest.approx(best)
    cost[2, :] = cost[:, 2] = np.inf
    assert len(tours.spanning_tree(cost)) == 4


# ---- clusters


@pytest.fixture(scope="module")
def town():
    rng = np.random.default_rng(4)
    xy = rng.random((240, 2)) * 0.3 + [40, -74]
    nodes = [int(a * 40) * 12 + int(b * 40) for a, b in xy - [40, -74]]
    grid = np.arange(12 * 12)
    at = np.stack([grid // 12, grid % 12], 1)
    return xy, nodes, paths.PairTimes(grid, np.abs(at[:, None] - at[None]).sum(2) * 180.0)


def test_size_clusters(town):
    xy, _, _ = town
    labels = clusters.by_size(xy, 20)
    sizes = np.bincount(labels)
    assert len(labels) == 240 and (sizes > 0).all() and sizes.std() < 12 and 8 <= len(sizes) <= 16
    assert (labels == clusters.by_size(xy, 20)).all()
    assert clusters.by_size(xy[:3], 1).tolist() == [0, 0, 0]
    assert set(clusters.by_size(np.repeat(xy[:1], 50, 0), 10)) <= set(range(10))


def test_weights_with_several_stops_at_an_address(town):
    """Repeated coordinates weigh as the addresses alone do: usual steps lead to other addresses."""
    xy, nodes, times = town
    labels = np.where(xy[:, 0] > 40.15, 1, 0)
    labels[::3] = -1
    left, taken = np.flatnonzero(labels < 0), np.flatnonzero(labels >= 0)
    full = np.array([0.4, 0.6])
    one = clusters.Clusterer(xy, clusters.SizeLimit(20), nodes, times)
    many = clusters.Clusterer(np.repeat(xy, 5, 0), clusters.SizeLimit(100), [n for n in nodes for _ in range(5)], times)
    near = clusters.Nearest(one, 2)
    near.add(taken, labels)
    weights = one.weights(left, labels, full, near)
    repeated = np.repeat(labels, 5)
    order = np.random.default_rng(1).permutation(np.flatnonzero(repeated >= 0))  # whatever the order of allocation
    beside = clusters.Nearest(many, 2)
    beside.add(order[:300], repeated)
    beside.add(order[300:], repeated)
    again = many.weights(np.flatnonzero(repeated < 0), repeated, full, beside)
    assert len(beside.points()) == len(taken)
    assert np.allclose(again, np.repeat(weights, 5)) and np.isfinite(again).all() and np.median(again) > 0.1
    by = clusters.by_shift(np.repeat(xy[:60], 5, 0), [n for n in nodes[:60] for _ in range(5)], np.array([[40.1, -73.9]]), [52], times, 300.0, 36000.0, most_rounds=8)
    assert np.unique(by).tolist() == list(range(by.max() + 1)) and by.max() >= 1


def test_nearest_allocated_points_equal_brute_force():
    rng = np.random.default_rng(2)
    xy = np.round(rng.random((60, 2)) * 4)  # many shared coordinates
    c = clusters.Clusterer(xy, clusters.SizeLimit(5))
    labels = np.full(60, -1)
    near = clusters.Nearest(c, 4)
    for which in np.split(rng.permutation(60)[:48], 8):
        labels[which] = rng.integers(0, 4, len(which))
        near.add(which, labels)
        taken = np.flatnonzero(labels >= 0)
        held = taken[np.unique(xy[taken], axis=0, return_index=True)[1]]
        assert sorted(near.points()) == sorted(held)
        for k in range(4):
            own = held[labels[held] == k]
            want = np.linalg.norm(xy[:, None] - xy[own][None], axis=2).min(1) if len(own) else np.full(60, np.inf)
            assert np.allclose(near.far[k], want)
            some = np.flatnonzero(np.isfinite(near.far[k]))
            assert np.allclose(np.linalg.norm(xy[some] - xy[near.who[k, some]], axis=1), want[some])


def test_two_nearest_clusters_and_steps_equal_brute_force():
    rng = np.random.default_rng(5)
    xy = rng.random((90, 2))
    c = clusters.Clusterer(xy, clusters.SizeLimit(5))
    assert c.single and (c.spots[c.place] == xy).all()
    labels = np.full(90, -1)
    near = clusters.Nearest(c, 5)
    apart = np.linalg.norm(c.spots[:, None] - c.spots[None], axis=2)
    for i, which in enumerate(np.split(rng.permutation(90)[:72], 12)):
        labels[which] = rng.integers(0, 1 if i < 2 else 5, len(which))  # one cluster only at first
        near.add(which, labels)
        held = near.held >= 0
        far = np.array([np.where(held & (near.label == k), apart, np.inf).min(1) for k in range(5)])
        open_, two = ~held, np.sort(far, 0)[:2]
        assert np.allclose(near.away[:, open_], two[:, open_])
        for j in range(2):
            some = np.flatnonzero(open_ & np.isfinite(two[j]))
            assert np.allclose(far[near.cluster[j, some], some], two[j, some]) and np.allclose(apart[some, near.spot[j, some]], two[j, some])
        others = np.sort(np.where(held & ~np.eye(90, dtype=bool), apart, np.inf), 1)[:, :2].T
        assert np.allclose(near.step, others) and np.allclose(apart[np.arange(90), near.beside], others)


def test_orders_at_an_address_are_placed_together(town, monkeypatch):
    """An address is one thing to place, however many orders it has, and counts as all of them."""
    xy, _, _ = town
    met, weights = [], clusters.Clusterer.weights
    monkeypatch.setattr(clusters.Clusterer, "weights", lambda self, left, *a: met.append(len(left)) or weights(self, left, *a))
    place = np.random.default_rng(2).permutation(np.repeat(np.arange(240), 10))
    labels = clusters.by_size(xy[place], 200)
    assert met and max(met) <= 240
    assert len(set(zip(place.tolist(), labels.tolist(), strict=True))) == 240
    sizes = np.bincount(labels)
    assert (sizes > 0).all() and sizes.sum() == 2400 and sizes.std() < 120 and 8 <= len(sizes) <= 16
    few = clusters.by_size(np.repeat(xy[:30], 20, 0), 10)  # more clusters wanted than addresses
    assert len(set(few.tolist())) == 30 and (np.bincount(few) == 20).all()


def test_thinned_equals_comparing_all():
    xy = np.random.default_rng(6).random((400, 2)) * [1, 3]
    for radius in (0.0, 0.01, 0.1, 0.35, 5.0):
        want = []
        for i in range(400):
            if not radius or all(((xy[i] - xy[j]) ** 2).sum() >= radius * radius for j in want):
                want.append(i)
        assert clusters.thinned(np.arange(400), xy, radius) == want


def test_routes_are_found_once(spark, net):
    """What shift_clusters returns is read from storage: joining its dense labels would else cluster every zone twice."""
    points = planner.snapped_points(tables.points(spark, SF).where("point_id < 60"), net)
    made = zones.shift_clusters(points, zones.plan_zones(points), net.graph, [(40.1, -73.9, 0)], most_rounds=2)
    assert "InPandas" not in made._jdf.queryExecution().toString() and made.count() == points.count()


def test_shift_clusters(town):
    xy, nodes, times = town
    depots, depot_nodes = np.array([[40.1, -73.9], [40.25, -73.75]]), [52, 113]
    labels = clusters.by_shift(xy, nodes, depots, depot_nodes, times, 300.0, 14400.0, most_rounds=12)
    limit = clusters.ShiftLimit(xy, nodes, depots, depot_nodes, times, 300.0, 14400.0)
    assert np.unique(labels).tolist() == list(range(labels.max() + 1))
    assert max(limit.route(np.flatnonzero(labels == c)) for c in range(labels.max() + 1)) < 1.5 * 14400
    again = clusters.by_shift(xy, nodes, depots, depot_nodes, times, 300.0, 14400.0, most_rounds=12)
    assert (labels == again).all()
    with pytest.raises(ValueError, match="no labelling"):
        clusters.by_shift(xy, nodes, depots, depot_nodes, times, 300.0, 400.0, most_rounds=2)


def test_moves(town):
    xy, nodes, times = town
    labels = (xy[:, 0] > 40.15).astype(int) * 2 + (xy[:, 1] > -73.85)
    labels[np.random.default_rng(0).choice(240, 6, replace=False)] = 3
    after, moves = refine.refined(xy, labels, nodes, times)
    assert moves and len(after) == 240
    assert all(m.profit > 0 and m.keep > m.cost and m.source != m.target for m in moves)
    assert sum(m.profit for m in moves) >= refine.LEAST_GAIN
    untouched = sorted(set(range(240)) - {i for m in moves for i in m.members})
    assert (after[untouched] == labels[untouched]).all()
    one, none = refine.refined(xy, np.zeros(240, int), nodes, times)
    assert not none and (one == 0).all()


def test_chosen_moves_are_disjoint():
    move = lambda a, b, p, n=1: refine.Move(list(range(n)), a, b, 0.0, 0.0, p)
    picked = refine.chosen_moves([move(0, 1, 100), move(1, 2, 90), move(3, 4, 80), move(5, 6, 10)])
    assert [(m.source, m.target) for m in picked] == [(0, 1), (3, 4), (5, 6)]
    assert refine.chosen_moves([move(0, 1, 19.0), move(2, 3, 100.0, 50)]) == []
    assert refine.chosen_moves([]) == []


def test_small_groups():
    tree = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 9.0)] + [(2, i, 2.0) for i in range(4, 12)]
    assert refine.small_groups(12, tree, [1] * 12) == [(9.0, [3])]
    assert refine.small_groups(12, tree, [1, 1, 1, 3] + [1] * 8) == []


def test_refinement_crosses_zone_borders(spark, net):
    """Two zones side by side; a stop of one zone's route lies amid the other's: only the shifted pass can move it."""
    points = tables.points(spark, SF)
    stops = planner.snapped_points(points, net).select("point_id", "lat", "lon", "node_id").collect()
    west = sorted(stops, key=lambda r: r.lon)
    label = {r.point_id: int(i >= len(west) // 2) for i, r in enumerate(west)}
    stray = west[-1].point_id
    label[stray] = 0
    rows = spark.createDataFrame([(*r, label[r.point_id], label[r.point_id], 0) for r in stops], "point_id long, lat double, lon double, node_id long, label long, bucket long, zone long")
    first = refine.refine_clusters(rows.withColumn("region", F.col("bucket")), net.graph, "region")
    assert {r.point_id: r.label for r in first.collect()} == label and refine.move_statistics(first).first().stops_moved == 0
    both = {r.point_id: r.label for r in planner.refined(rows, net).collect()}
    assert both[stray] == 1 and len(both) == len(label)
    whole = refine.refine_clusters(rows.withColumn("region", F.lit(0)), net.graph, "region")
    stats = refine.move_statistics(whole).first()
    held = whole.collect()
    assert stats.rounds >= 1 and stats.stops_moved == sum(r.moves for r in held) > 0
    assert stats.total_gain == pytest.approx(sum(r.gain for r in held)) and stats.gain_per_stop == pytest.approx(stats.total_gain / stats.stops_moved)


def test_stretches_hold_whole_clusters(spark):
    rng = random.Random(5)
    stops = spark.createDataFrame([(i, i // 10, 40 + (i // 10) / 50 + rng.random() / 100, -74.0) for i in range(1000)], "point_id long, label long, lat double, lon double")
    plain, shifted = ({r.label: r.region for r in zones.stretches(stops, 200, s).collect()} for s in (False, True))
    assert len(plain) == len(shifted) == 100
    sizes = [sum(r == k for r in plain.values()) for k in set(plain.values())]
    assert sizes == [20] * 5 and sorted(sum(r == k for r in shifted.values()) for k in set(shifted.values())) == [10, 10, 20, 20, 20, 20]


def test_times_from_a_table_equal_those_from_the_graph(spark, net):
    stops = planner.snapped_points(tables.points(spark, SF), net).withColumn("label", F.col("block")).withColumn("start_node", F.lit(int(net.graph.ids[7])))
    pairs = neighbours.pairs_within(stops.select("label", "node_id").unionByName(stops.select("label", F.col("start_node").alias("node_id"))), "label")
    table = paths.pair_seconds(pairs.select("a", "b"), net.graph)
    found, again = (sorted(map(tuple, tours.sequence_routes(stops, *x).collect())) for x in ((net.graph,), (None, table)))
    assert [r[:3] for r in found] == [r[:3] for r in again] and all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(found, again, strict=True))


def test_zones(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(i, 40 + rng.random(), -74 + rng.random()) for i in range(900)], "point_id long, lat double, lon double")
    got = zones.split_zones(points, 100).collect()
    assert len({r.point_id for r in got}) == len(got) == 900
    assert {r.bucket for r in got} == {0, 1, 2, 3, 4}
    assert max(sum((r.bucket, r.zone) == k for r in got) for k in {(r.bucket, r.zone) for r in got}) < 250
    assert {(r.bucket, r.zone) for r in zones.plan_zones(points).collect()} == {(0, 0)}
    dense = area.dense_labels(spark.createDataFrame([(r.bucket, r.zone) for r in got], "bucket long, zone long"), "bucket", "zone")
    ranks = {(r.bucket, r.zone): r.dense_label for r in dense.collect()}
    assert [ranks[k] for k in sorted(ranks)] == list(range(len(ranks)))


def test_leg_sum(spark):
    series = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 3), (2, 1, 4)], "label long, route_series int, node_id long")
    seconds = spark.createDataFrame([(3, 5, 7.0)], "a long, b long, duration double")
    assert [tuple(r) for r in tours.leg_seconds(series, seconds).collect()] == [(1, 7.0, 2)]


def test_weighted_centroid_is_pulled_in(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (1, 9.0, 9.0)], "label long, lat double, lon double")
    got = area.weighted_centroids(rows).first()
    assert got.lat < 3.0 and got.lat == pytest.approx(got.lon)
    assert area.sampled(rows.withColumn("point_id", F.monotonically_increasing_id()), 2, 1).count() == 2
