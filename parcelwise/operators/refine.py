"""Moving small groups of stops between routes along cuts of the routes' spanning trees."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.paths import PairTimes, RoadGraph, applied_with_times
from parcelwise.operators.tours import spanning_tree

LEAST_GAIN = 20.0  # seconds


@dataclass
class Move:
    members: list[int]
    source: int
    target: int
    keep: float
    cost: float
    profit: float

    @property
    def per_stop(self) -> float:
        return self.profit / len(self.members)


def cluster_tree(members: list[int], nodes: list[int], seconds: PairTimes, least: int = 3) -> tuple[list[int], list[tuple[int, int, float]]] | None:
    """(distinct road nodes, spanning tree over them); stops at one node are one vertex. None if under `least` stops or unconnected."""
    distinct = list(dict.fromkeys(nodes[i] for i in members))
    if len(members) < least or len(distinct) < 2:
        return None
    tree = spanning_tree(seconds.block(distinct, distinct))
    return (distinct, tree) if len(tree) == len(distinct) - 1 else None


def small_groups(n: int, tree: list[tuple[int, int, float]], weight: list[int], share: float = 0.1) -> list[tuple[float, list[int]]]:
    """(cut edge's seconds, vertices of its smaller side) for the longest tenth of the edges, cut one at a time.

    A side counts when it has at most `share` of all stops; weight is a vertex's stops.
    """
    around = defaultdict(list)
    for a, b, _ in tree:
        around[a].append(b)
        around[b].append(a)
    total, found = sum(weight), []
    for a, b, length in sorted(tree, key=lambda e: -e[2])[: max(1, int(0.1 * len(tree)))]:
        side, stack = {a}, [a]
        while stack:
            for v in around[stack.pop()]:
                if v not in side and v != b:
                    side.add(v)
                    stack.append(v)
        size = sum(weight[v] for v in side)
        own = sorted(side) if 2 * size <= total else sorted(set(range(n)) - side)
        if 0 < sum(weight[v] for v in own) <= share * total:
            found.append((length, own))
    return found


def best_target(group: list[int], source: int, points: np.ndarray, labels: np.ndarray, nodes: list[int], seconds: PairTimes, reach: int) -> tuple[float, int] | None:
    """(least drive seconds, cluster) among the other clusters of the `reach` points nearest to the group's mean."""
    far = np.linalg.norm(points - points[group].mean(0), axis=1)
    near = {int(x) for x in labels[np.argsort(far, kind="stable")[:reach]]} - {source, -1}
    options = []
    for target in sorted(near):
        cost = float(seconds.block([nodes[i] for i in group], [nodes[j] for j in np.flatnonzero(labels == target)]).min())
        if np.isfinite(cost):
            options.append((cost, target))
    return min(options, default=None)


def chosen_moves(moves: list[Move], most: int = 5) -> list[Move]:
    """The best moves by gain for each stop, no cluster twice; none if the first one gains under LEAST_GAIN in all."""
    ranked, used, out = sorted(moves, key=lambda m: (-m.per_stop, m.source, m.target, m.members)), set(), []
    if not ranked or ranked[0].profit < LEAST_GAIN:
        return []
    for m in ranked:
        if len(out) == most:
            break
        if not {m.source, m.target} & used:
            used |= {m.source, m.target}
            out.append(m)
    return out


def refined(points: np.ndarray, labels: np.ndarray, nodes: list[int], seconds: PairTimes, **limits) -> tuple[np.ndarray, list[Move]]:
    """(labels after all moves, the moves)."""
    return refined_rounds(points, labels, nodes, seconds, **limits)[:2]


def refined_rounds(points: np.ndarray, labels: np.ndarray, nodes: list[int], seconds: PairTimes, least: int = 3, share: float = 0.1, most_moves: int = 5, most_rounds: int = 100) -> tuple[np.ndarray, list[Move], int]:
    """(labels after all moves, the moves, the rounds that moved something); gains fade by 0.8 with each earlier move of a stop."""
    labels, done, moved = labels.copy(), [], Counter()
    n_clusters, rounds = len(np.unique(labels[labels >= 0])), 0
    if not n_clusters:
        return labels, done, rounds
    reach = max(2, min(len(points) // n_clusters, len(points) // 10))
    for _ in range(most_rounds):
        moves = []
        for c in np.unique(labels[labels >= 0]).tolist():
            members = np.flatnonzero(labels == c).tolist()
            built = cluster_tree(members, nodes, seconds, least)
            if built is None:
                continue
            distinct, tree = built
            at = defaultdict(list)
            for i in members:
                at[nodes[i]].append(i)
            for keep, own in small_groups(len(distinct), tree, [len(at[d]) for d in distinct], share):
                group = sorted(i for v in own for i in at[distinct[v]])
                best = best_target(group, c, points, labels, nodes, seconds, reach)
                if best is None:
                    continue
                profit = (keep - best[0]) * 0.8 ** max(moved[i] for i in group)
                if profit > 0:
                    moves.append(Move(group, c, best[1], keep, best[0], profit))
        picked = chosen_moves(moves, most_moves)
        if not picked:
            break
        for m in picked:
            labels[m.members] = m.target
            moved.update(m.members)
        done += picked
        rounds += 1
    return labels, done, rounds


REFINED = "point_id long, label long, moves int, gain double, rounds int"


def refine_clusters(stops: DataFrame, graph: RoadGraph | None, by: str, durations: DataFrame | None = None) -> DataFrame:
    """stops (point_id, lat, lon, node_id, label) with their labels after refinement, how often each was moved, its
    share of the seconds gained, and the rounds of its region.

    One task refines one region, a value of `by`, which must hold whole clusters and
    bounds the group; a round makes at most five moves in each region. Drive times come
    from the graph, or from `durations` if given.
    """

    def one(pdf: pd.DataFrame, times: PairTimes) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        labels, done, rounds = refined_rounds(pdf[["lat", "lon"]].to_numpy(float), pdf["label"].to_numpy(int), [int(x) for x in pdf["node_id"]], times)
        moves, gain = np.zeros(len(pdf), int), np.zeros(len(pdf))
        for m in done:
            moves[m.members] += 1
            gain[m.members] += m.per_stop
        return pd.DataFrame({"point_id": pdf["point_id"], "label": labels, "moves": moves, "gain": gain, "rounds": rounds})

    rows = stops.select("point_id", "lat", "lon", "node_id", "label", F.col(by).alias("_region"))
    return applied_with_times(rows, ["_region"], one, REFINED, graph, durations)


def move_statistics(refined_stops: DataFrame) -> DataFrame:
    """One row on a refinement: most rounds of a region, seconds gained, moves of stops, and seconds to each of them."""
    moved, gain = F.coalesce(F.sum("moves"), F.lit(0)), F.coalesce(F.sum("gain"), F.lit(0.0))
    out = refined_stops.agg(F.coalesce(F.max("rounds"), F.lit(0)).alias("rounds"), gain.alias("total_gain"), moved.alias("stops_moved"))
    return out.withColumn("gain_per_stop", F.when(F.col("stops_moved") > 0, F.col("total_gain") / F.col("stops_moved")))


def cluster_trees(stops: DataFrame, graph: RoadGraph | None, durations: DataFrame | None = None) -> DataFrame:
    """The spanning tree's edges of each cluster: label, a, b (road nodes), duration."""

    def one(pdf: pd.DataFrame, times: PairTimes) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        built = cluster_tree(list(range(len(pdf))), [int(x) for x in pdf["node_id"]], times, 2)
        rows = [] if built is None else [(min(built[0][a], built[0][b]), max(built[0][a], built[0][b]), s) for a, b, s in built[1]]
        return pd.DataFrame({"label": pd.Series([pdf["label"].iloc[0]] * len(rows), dtype="int64"), "a": pd.Series([r[0] for r in rows], dtype="int64"), "b": pd.Series([r[1] for r in rows], dtype="int64"), "duration": pd.Series([r[2] for r in rows], dtype="float64")})

    rows = stops.select("point_id", "node_id", F.col("label").cast("long").alias("label"))
    return applied_with_times(rows, ["label"], one, "label long, a long, b long, duration double", graph, durations)
