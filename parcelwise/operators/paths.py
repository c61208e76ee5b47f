"""Drive times over the broadcast road graph."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators.neighbours import pairs_within
from parcelwise.operators.roads import largest_component, refuse_large
from parcelwise.session import dealt


@dataclass
class RoadGraph:
    """A directed graph as CSR arrays; node ids are kept sorted."""

    ids: np.ndarray
    first: np.ndarray
    to: np.ndarray
    seconds: np.ndarray
    lat: np.ndarray
    lon: np.ndarray

    @classmethod
    def collect(cls, nodes: DataFrame, edges: DataFrame) -> RoadGraph:
        """From (node_id, lat, lon) and (start, end, duration): the graph of one planning area, of a size that is checked."""
        refuse_large(edges)
        n = nodes.select("node_id", "lat", "lon").toPandas().sort_values("node_id")
        e = edges.select("start", "end", "duration").toPandas()
        ids = n["node_id"].to_numpy(np.int64)
        a, b = (np.searchsorted(ids, e[c].to_numpy(np.int64)) for c in ("start", "end"))
        order = np.lexsort((b, a))
        first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))])
        return cls(ids, first, b[order], e["duration"].to_numpy(float)[order], n["lat"].to_numpy(float), n["lon"].to_numpy(float))

    def largest(self) -> RoadGraph:
        """The graph of the largest strongly connected component."""
        start = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        if not len(start):
            raise ValueError("the road graph has no edges")
        kept = np.zeros(len(self.ids), bool)
        kept[largest_component(start, self.to)] = True
        inner = kept[start] & kept[self.to]
        number = np.cumsum(kept) - 1
        first = np.concatenate([[0], np.cumsum(np.bincount(number[start[inner]], minlength=int(kept.sum())))])
        return RoadGraph(self.ids[kept], first, number[self.to[inner]], self.seconds[inner], self.lat[kept], self.lon[kept])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """node_id of every node; the graph's size is checked, so this small column may be broadcast."""
        return F.broadcast(spark.createDataFrame(pd.DataFrame({"node_id": self.ids})))

    def place(self, node: int) -> int:
        at = int(np.searchsorted(self.ids, node))
        if at == len(self.ids) or self.ids[at] != node:
            raise KeyError(node)
        return at

    def from_one(self, source: int, targets: set[int] | None = None, heuristic_kmh: float | None = None) -> dict[int, float]:
        """Seconds from a node to the targets (all if None) by node id; unreachable ones are missing.

        With heuristic_kmh and one target it is a best-first search that adds the time of
        the straight line at that speed, and may be longer than the shortest path.
        """
        start = self.place(source)
        left = None if targets is None else {self.place(t) for t in targets}
        goal = next(iter(left)) if heuristic_kmh and left and len(left) == 1 else None
        ahead = None
        if goal is not None:
            a, b = np.radians(self.lat), np.radians(self.lat[goal])
            chord = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(self.lon - self.lon[goal]) / 2) ** 2
            ahead = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, chord))) / heuristic_kmh * 3600
        first, to, cost = self.first, self.to, self.seconds
        best, settled, heap, out = {start: 0.0}, set(), [(0.0, start)], {}
        while heap and (left is None or left):
            _, u = heapq.heappop(heap)
            if u in settled:
                continue
            settled.add(u)
            d = best[u]
            if left is None or u in left:
                out[int(self.ids[u])] = d
                if left is not None:
                    left.discard(u)
            low, high = first[u], first[u + 1]
            for v, leg in zip(to[low:high].tolist(), cost[low:high].tolist(), strict=True):
                if v not in settled and (new := d + leg) < best.get(v, np.inf):
                    best[v] = new
                    heapq.heappush(heap, (new if ahead is None else new + float(ahead[v]), v))
        return out

    def times(self, nodes) -> PairTimes:
        """The drive times between the distinct nodes given, one search from each."""
        ids = np.unique(np.fromiter((int(x) for x in nodes), np.int64))
        seconds = np.full((len(ids), len(ids)), np.inf)
        for i, source in enumerate(ids.tolist()):
            found = self.from_one(source, set(ids[i:].tolist()))
            seconds[i, i:] = [found.get(t, np.inf) for t in ids[i:].tolist()]
        return PairTimes(ids, np.minimum(seconds, seconds.T))


@dataclass
class PairTimes:
    """Seconds of unordered pairs of a few nodes: from the lower id to the higher, inf without a path."""

    ids: np.ndarray
    seconds: np.ndarray

    @classmethod
    def of(cls, nodes, a: np.ndarray, b: np.ndarray, seconds: np.ndarray) -> PairTimes:
        """From a table of pairs a < b; a node is 0 from itself, pairs that are not in the table are inf."""
        ids = np.unique(np.fromiter((int(x) for x in nodes), np.int64))
        table = np.full((len(ids), len(ids)), np.inf)
        np.fill_diagonal(table, 0.0)
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        table[i, j] = table[j, i] = np.where(np.isnan(seconds), np.inf, seconds)
        return cls(ids, table)

    def __call__(self, a: int, b: int) -> float:
        return float(self.seconds[np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)])

    def legs(self, nodes) -> np.ndarray:
        """From each node to the next one."""
        at = np.searchsorted(self.ids, nodes)
        return self.seconds[at[:-1], at[1:]]

    def block(self, a, b) -> np.ndarray:
        return self.seconds[np.ix_(np.searchsorted(self.ids, a), np.searchsorted(self.ids, b))]


def from_sources(sources: DataFrame, graph: RoadGraph) -> DataFrame:
    """source, node_id and duration of everything that each distinct source (source) reaches."""
    held = sources.sparkSession.sparkContext.broadcast(graph)

    def search(batches):
        for pdf in batches:
            for s in pdf["source"]:
                found = held.value.from_one(int(s))
                yield pd.DataFrame({"source": [int(s)] * len(found), "node_id": list(found), "duration": list(found.values())})

    return dealt(sources.select(F.col("source").cast("long")).distinct(), "source").mapInPandas(search, "source long, node_id long, duration double")


def pair_seconds(pairs: DataFrame, graph: RoadGraph, known: DataFrame | None = None, directed: bool = False, heuristic_kmh: float | None = None) -> DataFrame:
    """(a, b, duration) of the distinct pairs asked for; duration is null where no path leads.

    Unordered unless `directed`: the time from the lower to the higher id counts for
    both. Pairs in `known` (a, b, duration) are not searched again. Pairs of one source
    are dealt together and found by one search, a source with very many of them by one
    for each salted part.
    """
    spark = pairs.sparkSession
    held = spark.sparkContext.broadcast(graph)
    low, high = (F.col("a"), F.col("b")) if directed else (F.least("a", "b"), F.greatest("a", "b"))
    asked = pairs.where("a is not null and b is not null").select(low.cast("long").alias("a"), high.cast("long").alias("b")).distinct()
    same = asked.where("a = b").withColumn("duration", F.lit(0.0))
    todo = asked.where("a <> b")
    if known is not None:
        todo = todo.join(known.select("a", "b"), ["a", "b"], "left_anti")

    def search(batches):
        for pdf in batches:
            for source, own in pdf.groupby("a"):
                targets = {int(b) for b in own["b"]}
                if heuristic_kmh:
                    found = {t: held.value.from_one(int(source), {t}, heuristic_kmh).get(t) for t in targets}
                else:
                    found = held.value.from_one(int(source), targets)
                yield pd.DataFrame({"a": own["a"], "b": own["b"], "duration": [found.get(int(b)) for b in own["b"]]}, dtype=object).astype({"a": "int64", "b": "int64", "duration": "float64"})

    salted = dealt(todo.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(8))), "a", "_salt").sortWithinPartitions("a").drop("_salt")
    found = salted.mapInPandas(search, "a long, b long, duration double").withColumn("duration", F.when(~F.isnan("duration"), F.col("duration")))
    out = found.unionByName(same)
    if known is not None:
        out = out.unionByName(asked.join(known.select("a", "b", "duration"), ["a", "b"]).where("a <> b"))
    return out


def applied_with_times(rows: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame, PairTimes], pd.DataFrame], schema: str, graph: RoadGraph | None, durations: DataFrame | None = None, more: Sequence[int] = ()) -> DataFrame:
    """f(group, drive times between its nodes) for each group of rows by keys, of a size that the caller bounds.

    Its nodes are those of `node_id`, of `start_node` if there is one, and `more`. Times
    come from searches in the broadcast graph, or from `durations` (a, b, duration), which
    must hold every pair: then nothing is searched and no graph is needed.
    """
    ends = ["node_id", *(["start_node"] if "start_node" in rows.columns else [])]
    nodes_of = lambda pdf: [*pd.concat([pdf[c] for c in ends]).dropna(), *more]
    if durations is None:
        held = rows.sparkSession.sparkContext.broadcast(graph)
        return dealt(rows, *keys).groupBy(*keys).applyInPandas(lambda pdf: f(pdf, held.value.times(nodes_of(pdf))), schema)
    own = rows.select(*keys, F.explode(F.array(*[F.col(c).cast("long") for c in ends], *[F.lit(int(x)).cast("long") for x in more])).alias("node_id")).where("node_id is not null")
    pairs = pairs_within(own, *keys).join(durations.select("a", "b", "duration"), ["a", "b"])
    theirs = [f"_{k}_of_pair" for k in keys]
    pairs = pairs.select(*(F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)), "a", "b", "duration")

    def one(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return f(pdf, PairTimes.of(nodes_of(pdf), *(known[c].to_numpy() for c in ("a", "b", "duration"))))

    return dealt(rows, *keys).groupBy(*keys).cogroup(dealt(pairs, *theirs).groupBy(*theirs)).applyInPandas(one, schema)


def with_seconds(pairs: DataFrame, durations: DataFrame) -> DataFrame:
    """Every pair asked for, repeats and order columns kept, with its duration or null."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()  # least and greatest pass over nulls
    key = pairs.select("*", F.when(both, F.least("a", "b")).alias("_a"), F.when(both, F.greatest("a", "b")).alias("_b"))
    return key.join(durations.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "duration"), ["_a", "_b"], "left").drop("_a", "_b")
