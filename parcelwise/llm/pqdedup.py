"""Embedding near-duplicates by product quantisation.

Equal vectors of a label are one class. Coarse centroids and residual subspace codebooks
are fitted on a bounded sample; then every class is put into the inverted list of its
nearest centroid with its residual's codes and the length `err` of what they miss. A
query probes each list whose cell comes within the link radius r of it (cosine c is
distance r = sqrt(2 - 2c) on the unit sphere): its distance to the plane between that
list's centroid and any of its own NEAREST nearest ones is at most r. In a list, table
lookups give its distance to all coded vectors; whatever is nearer than r + err can be a
link and is reranked by exact cosine in double precision. Both bounds are exact, so no
link is lost and recall is 1.

Lists grow in number with the largest label, and neighbouring lists form groups of about
`block` of its members: a query's vector travels once to each group in which it probes a
list, and is compared with the members of the probed lists only. Groups longer than `block`
are dealt into blocks by hash; a query meets each block. Links are never listed pair by pair:
a block returns each query's number of links and a spanning forest, at most one row for
each query and member. Block numbers come from counts by group and hashed label; that
table has at most MOST_LISTS x LABEL_SLOTS rows, whatever the input.

Vectors that are null, empty, zero or hold null or non-finite components, those with a
null label and those with a null vec_id link with nothing; vectors of different length
never link. Repeated rows are copies of each other and count as links. Empty tables give
nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.common import text_buffers
from parcelwise.llm.components import connected
from parcelwise.session import stored

LABEL_SLOTS = 1024
MOST_LISTS = 2048
LIST_MEMBERS = 64  # classes of the largest label to a list, as long as MOST_LISTS are enough
AT_ONCE = 2048  # queries, and members of a list, that are compared in one step
NEAREST = 2
ODD = -1  # the list and group of vectors of another length than the quantiser's
SLACK = 1e-4  # for single-precision distances
INDEX = "label long, node long, weight long, vec binary, list int, part int, probes array<struct<part:int,lists:array<int>>>, codes binary, err float"


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Quantiser:
    coarse: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # by subspace: (codes, width)
    cuts: np.ndarray  # subspace borders
    groups: np.ndarray  # (lists,): the group of each list
    gap: np.ndarray = field(init=False)  # (lists, lists): distances between centroids

    def __post_init__(self):
        square = (self.coarse**2).sum(1)
        self.gap = np.sqrt(np.maximum(0, square[:, None] + square - 2 * self.coarse @ self.coarse.T))

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = 8, codes: int = 128, groups: int | None = None) -> Quantiser:
        """From unit vectors (n, dim)."""
        x = x.astype(np.float64)
        coarse = kmeans(x, lists, 8)
        rest = x - coarse[((coarse**2).sum(1) - 2 * x @ coarse.T).argmin(1)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        centres = kmeans(coarse, groups or len(coarse), 8, 2)
        group = ((centres**2).sum(1) - 2 * coarse @ centres.T).argmin(1)
        return cls(coarse, [kmeans(rest[:, a:b], codes, 6, 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts, group.astype(np.int32))

    def encode(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, probed lists as a mask, codes, err) of unit vectors."""
        d2 = (x**2).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        some = min(NEAREST, d2.shape[1])
        nearest = np.argpartition(d2, some - 1, 1)[:, :some]
        own, rows = d2.argmin(1), np.arange(len(x))
        probed = np.ones(d2.shape, bool)
        for k in range(nearest.shape[1]):
            near = nearest[:, k]
            probed &= d2 - d2[rows, near][:, None] <= 2 * (radius + SLACK) * self.gap[near] + SLACK
        rest = x - self.coarse[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        missed = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            far = (book**2).sum(1) - 2 * part @ book.T
            codes[:, m] = far.argmin(1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(1)
        return own, probed, codes, np.sqrt(missed)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """By subspace, twice the product of each query's part and each code, which no list changes."""
        return [(2 * q[:, a:b] @ book.T).astype(np.float32) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]

    def offsets(self, number: int, codes: np.ndarray) -> np.ndarray:
        """By coded vector of a list, what its codes add to a distance whatever the query."""
        out = np.zeros(len(codes))
        for m, book in enumerate(self.books):
            centre = self.coarse[number, self.cuts[m] : self.cuts[m + 1]]
            out += ((book**2).sum(1) + 2 * book @ centre)[codes[:, m]]
        return out

    def distances(self, q: np.ndarray, number: int, codes: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of a list, by table lookup."""
        out = (((q - self.coarse[number]) ** 2).sum(1)[:, None] + self.offsets(number, codes)).astype(np.float32)
        for m, table in enumerate(tables or self.tables(q)):
            out -= table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision; each row's length is worked out on its own, so that it is the same anywhere."""
    x = x.astype(np.float64)
    return x / np.sqrt(np.add.reduce(x * x, axis=1))[:, None]


def by_length(offs: np.ndarray, flat: np.ndarray):
    """Yields (rows, their vectors as a matrix) of each length among rows given by offsets into flat."""
    sizes = np.diff(offs)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        whole = len(rows) == len(sizes)
        yield rows, flat[offs[0] : offs[-1]].reshape(-1, n) if whole else flat[offs[rows][:, None] + np.arange(n)]


def _encoded(batches, q: Quantiser, radius: float):
    """Vectors of another length than the quantiser's are compared among themselves, without codes."""
    dim = q.coarse.shape[1]
    for batch in batches:
        column, n = batch.column(3), len(batch)
        flat = column.values.to_numpy(zero_copy_only=False)
        offs = column.offsets.to_numpy()
        own, err = np.full(n, ODD, np.int32), np.zeros(n, np.float32)
        width = np.zeros(n, np.int64)
        codes = np.zeros((n, len(q.books)), np.uint8)
        pairs = []
        for rows, x in by_length(offs, flat):
            if x.shape[1] != dim:
                pairs.append((rows, np.full(len(rows), ODD)))
                continue
            own[rows], mask, codes[rows], err[rows] = q.encode(unit(x), radius)
            width[rows] = len(q.books)
            i, j = np.nonzero(mask)
            pairs.append((rows[i], j))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        part = np.append(q.groups, ODD).astype(np.int32)  # that of list ODD stands last
        order = np.lexsort((j, part[j], i))
        i, j, g = i[order], j[order].astype(np.int32), part[j[order]]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (g[1:] != g[:-1])])) if len(i) else np.zeros(0, int)
        inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(i)).astype(np.int32)), pa.array(j))
        asked = pa.StructArray.from_arrays([pa.array(g[first]), inner], ["part", "lists"])
        probes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(i[first], minlength=n))).astype(np.int32)), asked)
        binary = lambda sizes, raw: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32).tobytes()), pa.py_buffer(raw)])
        vec = binary(np.diff(offs) * flat.itemsize, flat[offs[0] : offs[-1]].tobytes())
        arrays = [batch.column(0), batch.column(1), batch.column(2), vec, pa.array(own), pa.array(part[own]), probes, binary(width, codes[own >= 0].tobytes()), pa.array(err)]
        yield pa.RecordBatch.from_arrays(arrays, names=["label", "node", "weight", "vec", "list", "part", "probes", "codes", "err"])


def column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def vectors_of(table: pa.Table, kind: str):
    """Yields (rows, unit vectors) by length."""
    offs, raw = text_buffers(column(table, "vec"))
    flat = raw.view(kind)
    for rows, x in by_length(offs // flat.itemsize, flat):
        yield rows, unit(x)


class Block:
    """The members of one block of a group of lists, in the order of their lists."""

    def __init__(self, quantiser: Quantiser, members: pa.Table, cosine: float, kind: str):
        self.q, self.cosine, self.kind = quantiser, cosine, kind
        self.by_dim: dict[int, tuple] = {}
        get = lambda c: column(members, c).to_numpy()
        lists, nodes, weights, err = (get(c) for c in ("list", "node", "weight", "err"))
        ends, raw = text_buffers(column(members, "codes"))
        for rows, x in vectors_of(members, kind):
            order = np.argsort(lists[rows], kind="stable")
            rows, x = rows[order], x[order]
            numbers, cut = np.unique(lists[rows], return_index=True)
            codes = raw[ends[rows][:, None] + np.arange(len(quantiser.books))] if numbers[0] != ODD else np.zeros((len(rows), 0), np.uint8)
            self.by_dim[x.shape[1]] = x, codes, err[rows], nodes[rows], weights[rows], np.arange(len(rows)), list(zip(numbers.tolist(), cut, [*cut[1:], len(rows)], strict=True))

    def meet(self, queries: pa.Table):
        """Yields (node, its links by weight, None) and forest links (node, 0, member)."""
        radius = np.sqrt(2 - 2 * self.cosine) + SLACK
        ids, asked = column(queries, "node").to_numpy(), column(queries, "lists")
        owner = np.repeat(np.arange(len(queries)), np.diff(asked.offsets.to_numpy()))
        probes = asked.flatten().to_numpy()
        for rows, q in vectors_of(queries, self.kind):
            if q.shape[1] not in self.by_dim:
                continue
            x, codes, err, nodes, weights, label, lists = self.by_dim[q.shape[1]]
            place = np.full(len(queries), -1)
            place[rows] = np.arange(len(rows))
            tables = self.q.tables(q) if lists[0][0] != ODD else None
            found = []
            for number, lo, hi in lists:
                own = place[owner[probes == number]]
                own = own[own >= 0]
                if not len(own):
                    continue
                mine = [t[own] for t in tables] if tables else None
                for at in range(lo, hi, AT_ONCE):
                    to = min(at + AT_ONCE, hi)
                    near = nodes[None, at:to] != ids[rows[own]][:, None]
                    if mine:
                        near &= self.q.distances(q[own], number, codes[at:to], mine) <= (radius + err[at:to])[None, :] + SLACK
                    i, j = np.nonzero(near)
                    for k in range(0, len(i), 65536):  # the same sums for a pair in either direction
                        a, b = own[i[k : k + 65536]], j[k : k + 65536] + at
                        ok = np.einsum("ij,ij->i", q[a], x[b]) >= self.cosine
                        found.append((a[ok], b[ok]))
            if not found:
                continue
            i, j = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            counts = np.bincount(i, weights[j], len(rows)).astype(np.int64)
            cut = np.searchsorted(i, np.arange(len(rows) + 1))
            for row in np.flatnonzero(counts):
                linked = j[cut[row] : cut[row + 1]]
                parts, first = np.unique(label[linked], return_index=True)
                yield int(ids[rows[row]]), int(counts[row]), None
                for k in first:
                    yield int(ids[rows[row]]), 0, int(nodes[linked[k]])
                if len(parts) > 1:
                    label[np.isin(label, parts)] = parts[0]


def _met(batches, q: Quantiser, cosine: float, kind: str, at_once: int = AT_ONCE):
    """A sorted stream of (label, group, block, asks, ...): each block's members, then its queries."""
    key, members, block, queries, out = None, [], None, [], []

    def flush():
        nonlocal queries, block
        if queries and members:
            block = block or Block(q, pa.Table.from_batches(members), cosine, kind)
            out.extend(block.meet(pa.Table.from_batches(queries)))
        queries = []

    for batch in batches:
        parts = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("label", "part", "block", "asks")]
        change = np.concatenate([[True], np.logical_or.reduce([p[1:] != p[:-1] for p in parts]), [True]]) if len(batch) else np.zeros(0, bool)
        edges = np.flatnonzero(change)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (now := tuple(p[a] for p in parts[:3])) != key:
                flush()
                key, members, block = now, [], None
            if not parts[3][a]:
                members.append(batch.slice(a, b - a))
                continue
            for k in range(a, b, at_once):
                queries.append(batch.slice(k, min(at_once, b - k)))
                if sum(map(len, queries)) >= at_once:
                    flush()
        if len(out) > 10000:
            yield _links(out)
            out = []
    flush()
    yield _links(out)


def _links(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "n", "b"])


def sound(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample_rows: int = 8192, block: int = 16384) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label).

    `sample_rows` bounds the sample that the quantiser is fitted on (about so many rows
    of least hash, at most twice as many); there is a list for each LIST_MEMBERS classes of
    the largest label, from 8 lists to MOST_LISTS, and a group of lists for each `block`.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(f"array<{element}>").alias("v"))
    rows = rows.select("vec_id", "label", "v", (sound(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"), F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", F.lit(1), "label").alias("k2"))
    good = rows.where("ok")
    classes = good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = stored(classes.select("label", "node", "weight", "v", "k1", "k2"), "classes")
    n, most = classes.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    draw = F.pmod(F.xxhash64("k1", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))
    sample = classes.where(draw).select("v").limit(2 * sample_rows).toPandas()["v"]
    sizes = sample.map(len)
    dim = int(sizes.mode().iloc[0]) if len(sizes) else 1
    x = np.stack(sample[sizes == dim]) if len(sizes) else np.ones((1, 1))
    radius = float(np.sqrt(2 - 2 * cosine))
    lists = int(np.clip(most / LIST_MEMBERS, 8, MOST_LISTS))
    fitted = Quantiser.fit(unit(x), lists, groups=int(np.clip(most / block, 1, lists)))
    held = vectors.sparkSession.sparkContext.broadcast(fitted)
    index = stored(classes.select("label", "node", "weight", "v").mapInArrow(lambda it: _encoded(it, held.value, radius), INDEX), "pq-index")

    slot = F.pmod(F.hash("label"), F.lit(LABEL_SLOTS)).alias("slot")
    long_groups = index.groupBy(slot, "part").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long_groups = F.broadcast(long_groups.select("slot", "part", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    member = index.withColumn("slot", slot).join(long_groups, ["slot", "part"], "left")
    member = member.select("label", "part", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.lit(False).alias("asks"), "node", "weight", "vec", "list", "codes", "err", F.lit(None).cast("array<int>").alias("lists"))
    probed = index.select("label", "node", "vec", F.explode("probes").alias("g"))
    asking = probed.select("label", slot, F.col("g.part").alias("part"), F.col("g.lists").alias("lists"), "node", "vec").join(long_groups, ["slot", "part"], "left")
    asking = asking.select("label", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("asks"), "node", F.lit(None).cast("long").alias("weight"), "vec", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("err"), "lists")
    key = ["label", "part", "block"]
    met = member.unionByName(asking).repartition(*key).sortWithinPartitions(*key, "asks")
    found = stored(met.mapInArrow(lambda it: _met(it, held.value, cosine, kind), "a long, n long, b long"), "pq-links")
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected(found.where("b is not null").select("a", "b"), "pq")
    out = classes.select("node", "weight", "label", "k1", "k2").join(linked, "node", "left").join(parts, "node", "left")
    out = out.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = rows.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), "k1", "k2")
    done = alone.join(out, ["label", "k1", "k2"], "left")
    done = done.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
