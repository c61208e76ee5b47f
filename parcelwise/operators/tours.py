"""Tours over the stops of a route: spanning tree, perfect matching, Euler circuit, shortcuts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.operators.matching import perfect_matching
from parcelwise.operators.paths import PairTimes, RoadGraph, applied_with_times


def spanning_tree(cost: np.ndarray) -> list[tuple[int, int, float]]:
    """A minimum spanning tree's edges (Prim); inf means no edge, a part that stays unconnected is left out."""
    n = len(cost)
    best, link, inside, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    best[0] = 0.0
    for _ in range(n):
        u = int(np.argmin(np.where(inside, np.inf, best)))
        if inside[u] or not np.isfinite(best[u]):
            break
        inside[u] = True
        if u:
            out.append((int(link[u]), u, float(best[u])))
        nearer = ~inside & (cost[u] < best)
        best[nearer], link[nearer] = cost[u][nearer], u
    return out


def circuit(cost: np.ndarray, start: int = 0) -> list[int]:
    """A closed tour's order from `start`, at most 1.5 times the shortest where cost is a metric."""
    n = len(cost)
    if n < 3:
        return [start, *(i for i in range(n) if i != start)]
    around: list[list[int]] = [[] for _ in range(n)]
    for a, b, _ in spanning_tree(cost):
        around[a].append(b)
        around[b].append(a)
    odd = [i for i in range(n) if len(around[i]) % 2]
    for i, j in perfect_matching(cost[np.ix_(odd, odd)]):
        around[odd[i]].append(odd[j])
        around[odd[j]].append(odd[i])
    stack, walk = [start], []
    while stack:
        u = stack[-1]
        if around[u]:
            v = around[u].pop()
            around[v].remove(u)
            stack.append(v)
        else:
            walk.append(stack.pop())
    return list(dict.fromkeys(walk[::-1]))


def cost_matrix(nodes: list[int], seconds: PairTimes) -> np.ndarray:
    out = seconds.block(nodes, nodes)
    return np.where(np.isfinite(out), out, 1e9)


def sequence(stops: list[int], start: int | None, seconds: PairTimes) -> list[int]:
    """The place of each stop (given by its road node) on the route, from 0; stops at one node stay in their order."""
    if len(stops) < 2:
        return [0] * len(stops)
    distinct = list(dict.fromkeys(stops))
    if len(distinct) < 3:
        order = distinct
    else:
        nodes = distinct if start is None or start in distinct else [*distinct, start]
        first = 0 if start is None else nodes.index(start)
        order = [nodes[i] for i in circuit(cost_matrix(nodes, seconds), first)]
    at = {node: k for k, node in enumerate(order)}
    ranked = sorted(range(len(stops)), key=lambda i: (at[stops[i]], i))
    out = [0] * len(stops)
    for place, i in enumerate(ranked):
        out[i] = place
    return out


def route_seconds(stops: list[int], places: list[int], start: int | None, seconds: PairTimes) -> float:
    """Drive time from the start over the stops in order, without a way back."""
    ordered = [s for _, s in sorted(zip(places, stops, strict=True))]
    legs = ordered if start is None else [start, *ordered]
    return float(sum(seconds.legs(legs).tolist()))


def tour(stops: list[int], start: int | None, seconds: PairTimes) -> tuple[float, list[int]]:
    """(drive seconds, places); fewer than two places to connect take no time."""
    if len(stops) + (start is not None) < 2:
        return 0.0, [0] * len(stops)
    places = sequence(stops, start, seconds)
    return route_seconds(stops, places, start, seconds), places


def sequence_routes(stops: DataFrame, graph: RoadGraph | None, durations: DataFrame | None = None) -> DataFrame:
    """stops (label, point_id, node_id, start_node) with route_series from 1 and the route's travel seconds.

    One group is one route, which a shift bounds. Drive times come from the graph, or
    from `durations` if given.
    """

    def one(pdf: pd.DataFrame, times: PairTimes) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        start = pdf["start_node"].iloc[0]
        stops, start = [int(x) for x in pdf["node_id"]], None if pd.isna(start) else int(start)
        seconds, places = tour(stops, start, times)
        return pd.DataFrame({"label": pdf["label"], "point_id": pdf["point_id"], "route_series": [p + 1 for p in places], "travel_seconds": seconds})

    return applied_with_times(stops.select("label", "point_id", "node_id", "start_node"), ["label"], one, "label long, point_id long, route_series long, travel_seconds double", graph, durations)


def leg_seconds(series: DataFrame, durations: DataFrame) -> DataFrame:
    """label and the sum of its legs' durations, from stops in order (label, route_series, node_id) and pair durations."""
    before = F.lag("node_id").over(Window.partitionBy("label").orderBy("route_series"))
    legs = series.select("label", before.alias("a"), F.col("node_id").alias("b")).where("a is not null and b is not null")
    key = legs.select("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    timed = key.join(durations, ["a", "b"], "left").withColumn("s", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("duration")))
    return timed.groupBy("label").agg(F.sum("s").alias("travel_seconds"), F.count("*").alias("n_legs"))
