"""SimHash near-duplicates through a byte-position index with count filtering.

A fingerprint bit is the majority of that bit among the XXH64 hashes of the text's word
shingles. Two fingerprints that differ in at most `bits` = 4 bits differ in at most four
of their eight bytes, so at least four positional bytes agree. A posting list for a
single byte would hold a 256th of the corpus; instead the index is keyed by those 20
triples of positions (with their bytes) of which any four positions contain one, so
that every pair with four shared bytes meets in a list, and lists are 2^24 times
shorter than the corpus. Over `WIDE` distinct fingerprints the keys are all 70 fours of
positions, which gives the same links from lists 2^32 times shorter. The positional
bytes of pairs that meet are tallied, those with fewer than the guaranteed four shared
ones dropped, and only the rest verified by their differing bits.

Equal fingerprints are one node. In a list longer than `pairwise` the members are not
paired with each other: a breadth-first search takes one member after another and
removes what it links from the members left, which gives a spanning forest of the very
same components, at most one link for each member. A triple's list longer than `longest`
is not held: its task passes the members on, each to the five lists of the triple and one
position more, as a pair with four shared bytes shares one of those; they are dealt anew.
What a task holds of a list is therefore bounded by `longest` members, or by the prints
that have four bytes in common.

A text without words, null included, has fingerprint zero and is linked like any other;
fewer words than a shingle give one shingle; repeated rows share node and component.
A null doc_id has a fingerprint and is in a component, but never names one unless all
of its doc_ids are null. Nodes are the fingerprints themselves: where a doc_id repeats
with different texts, each row is in its own text's component, and two components may
have the same least doc_id. Other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import by_blocks, small_batches
from parcelwise.llm.components import connected
from parcelwise.session import stored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WIDE = 1 << 26
LONGEST = 1 << 14
SALTS = 16
SHINGLES = 1 << 18  # hashes whose bits are counted at once
SEED = 42


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions of which every 4 positions contain one: thirds (a, b, c), triples
    inside a third or with two positions of a third and one of the next."""
    third = [0, 0, 0, 1, 1, 1, 2, 2]
    fits = lambda t: len(set(t)) == 1 or any(t.count(k) == 2 and (k + 1) % 3 in t for k in t)
    return [t for t in combinations(range(8), 3) if fits([third[i] for i in t])]


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    found = WORD.findall((text or "").encode().translate(LOW))
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(found))
    first, last = (ends - sizes)[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), SHINGLES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + SHINGLES], last[i : i + SHINGLES], strict=True)], "<u8")
        columns = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += columns.sum(0, dtype=np.int64)
    bits = (2 * set_bits > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


# A-Z in lower case, on bytes of UTF-8.
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fingerprints(batches, words: int, names: list[str]):
    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t.as_py(), words) for t in block.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(prints.view(np.int64)), *block.columns[2:]], names=names)

    yield from by_blocks(batches, "text", one)


def fingerprints(docs: DataFrame, words: int = 4, **more: Column) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long) and the longs `more`. No exchange."""
    names = ["doc_id", "print", *more]
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.alias(n) for n, c in more.items()))
    return rows.mapInArrow(lambda it: _fingerprints(it, words, names), ", ".join(f"{n} long" for n in names))


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By pair, how many of the eight positional bytes are shared."""
    x, y = (np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8) for v in np.broadcast_arrays(a, b))
    return (x == y).sum(1)


def verified(a: np.ndarray, b: np.ndarray, bits: int, least_shared: int) -> np.ndarray:
    """The numbers of the pairs that reach the least count of shared bytes and then differ in at most `bits` bits."""
    a, b = np.broadcast_arrays(a, b)
    passed = np.flatnonzero(tally(a, b) >= least_shared)
    return passed[np.bitwise_count(a[passed] ^ b[passed]) <= bits]


def list_links(prints: np.ndarray, bits: int, least_shared: int) -> np.ndarray:
    """Links (i, j) that span the components of one posting list."""
    left, found = np.arange(len(prints)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = verified(prints[left], prints[i], bits, least_shared)
            if len(near):
                found += [(i, j) for j in left[near]]
                queue += left[near].tolist()
                left = np.delete(left, near)
    return np.array(found, np.int64).reshape(-1, 2)


def _linked(batches, bits: int, least_shared: int, pairwise: int, longest: int | None):
    """Links within runs of equal keys of a sorted stream of (key, print, node), and the members of runs over `longest`."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def links(key, prints, nodes):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edge)
        late = sizes > longest if longest else np.zeros(len(sizes), bool)
        if late.any():
            rows = np.repeat(late, sizes)
            yield passed_on(key[rows], prints[rows], nodes[rows])
        a, b = [], []
        for n in np.unique(sizes[(sizes > 1) & (sizes <= pairwise)]):  # all short lists of one length together
            rows = edge[:-1][sizes == n][:, None]
            for i, j in combinations(range(int(n)), 2):
                a.append((rows + i).ravel())
                b.append((rows + j).ravel())
        for start, n in zip(edge[:-1][(sizes > pairwise) & ~late], sizes[(sizes > pairwise) & ~late], strict=True):
            pairs = list_links(prints[start : start + n], bits, least_shared) + start
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        near = verified(prints[a], prints[b], bits, least_shared)
        none = pa.nulls(len(near), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a[near]]), pa.array(nodes[b[near]]), none, none], names=names)

    def passed_on(key, prints, nodes):
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(key), pa.array(prints.view(np.int64))], names=names)

    held, gone = None, None
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        if gone is not None:  # the list whose members are passed on may go on
            n = int(np.searchsorted(now[0], gone, "right"))
            yield passed_on(*(x[:n] for x in now))
            now = [x[n:] for x in now]
            gone = gone if not len(now[0]) else None
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last list may go on
        if cut:
            yield from links(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        if longest and len(held[0]) > longest:
            gone = held[0][0]
            yield passed_on(*held)
            held = None
    if held is not None and len(held[0]):
        yield from links(*held)


FOUND = "a long, b long, key long, print long"


def _matched(index: DataFrame, bits: int, pairwise: int, longest: int | None) -> DataFrame:
    """Links and members passed on of an index (key, print, node)."""
    dealt = index.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _linked(it, bits, 8 - bits, pairwise, longest), FOUND)


def _byte(place) -> Column:
    return F.call_function("shiftrightunsigned", F.col("print"), F.lit(8) * place).bitwiseAND(F.lit(255))


def near_links(nodes: DataFrame, bits: int = 4, pairwise: int = 16, wide: int = WIDE, longest: int = LONGEST) -> DataFrame:
    """Links (a, b) between nodes (node, print) with different prints of at most `bits` differing bits.

    Not every such pair is listed, but the links' components are those of all pairs.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees shared bytes for 4 bits at most")
    triples, few = position_triples(), nodes.count() <= wide
    keys = []
    for k, places in enumerate(triples if few else combinations(range(8), 8 - bits)):
        part = F.lit(k).cast("long")
        for p in places:
            part = F.shiftleft(part, 8).bitwiseOR(_byte(F.lit(p)))
        keys.append(part)
    index = nodes.select(F.explode(F.array(*keys)).alias("key"), "print", "node")
    if not few:
        return _matched(index, bits, pairwise, None).select("a", "b")
    found = stored(_matched(index, bits, pairwise, longest), "matched")
    others = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in t]) for t in triples])
    late = found.where("key is not null").select("key", "print", F.col("a").alias("node"), F.explode(F.get(others, F.shiftright("key", 24).cast("int"))).alias("place"))
    finer = F.shiftleft(F.shiftleft("key", 3).bitwiseOR(F.col("place")), 8).bitwiseOR(_byte(F.col("place")))
    more = _matched(late.select(finer.alias("key"), "print", "node"), bits, pairwise, None)
    return found.where("key is null").unionByName(more).select("a", "b")


def components(prints: DataFrame, bits: int) -> DataFrame:
    """print, part (the least print reachable) and component_id (the part's least doc_id) of every print.

    Prints without links, the many, are parts of their own. The names of the others come
    back by a salted join, as a part may hold very many prints; its copies of the names
    are not to be broadcast, whatever their size before they are copied.
    """
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected(near_links(nodes.select("print", F.col("print").alias("node")), bits), "simhash")
    parts = nodes.join(found.select(F.col("node").alias("print"), F.col("component").alias("part")), "print", "left")
    linked = parts.where("part is not null").withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int"))
    names = linked.groupBy("part").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.join(names.hint("merge"), ["part", "salt"]).select("print", "part", "component_id")
    return parts.where("part is null").select("print", F.col("print").alias("part"), F.col("least").alias("component_id")).unionByName(named)


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """doc_id, print and component_id (the least doc_id reachable) of every row."""
    prints = stored(fingerprints(docs, words), "prints")
    return prints.join(components(prints, bits), "print", "left").select("doc_id", "print", "component_id")


def firsts(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """One row of each component: the first by doc_id, null ids last, then by text.

    A component without any id keeps a row too, and where a doc_id repeats with texts
    that are no near copies each of them stays. Rows equal in doc_id and text are one.
    """
    key = {"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(1), "doc_id", "text")}
    prints = stored(fingerprints(docs, words, **key), "prints")
    first = prints.join(components(prints, bits), "print").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = stored(first.select("part", "_k1", "_k2").distinct(), "firsts")
    several = stored(first.join(first.groupBy("part").count().where("count > 1"), "part", "left_semi"), "several")
    keyed = docs.withColumns(key)
    texts = keyed.select("_k1", "_k2", "text").join(several, ["_k1", "_k2"])
    chosen = texts.groupBy("part").agg(F.min(F.struct(F.col("text"), F.col("_k1"), F.col("_k2"))).alias("s")).select("s._k1", "s._k2")
    alone = first.join(several, "part", "left_anti").select("_k1", "_k2")
    chosen = stored(alone.unionByName(chosen), "chosen")
    return keyed.join(chosen, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*docs.columns)


def kept(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """The rows of `firsts` that have a doc_id: components without any id are left out."""
    return firsts(docs, bits, words).where("doc_id is not null")
