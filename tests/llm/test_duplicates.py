import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwise.llm import components, pqdedup, simhash


def components_of(nodes, links):
    part = {n: n for n in nodes}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            part[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(random.Random(i).randrange(150), random.Random(-i - 1).randrange(150)) for i in range(120)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.connected(df, "test").collect()}
    links = [(a, b) for a, b in links if a != b]
    want = components_of({x for link in links for x in link}, links)
    assert got == want


def test_triples_cover_all_fours():
    triples = simhash.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def plain_print(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_texts):
    for t in odd_texts[:-1]:
        assert simhash.fingerprint(t) == plain_print(t)


def test_blocks_of_hashes_add_up(odd_texts, monkeypatch):
    want = simhash.fingerprint(odd_texts[-1])
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert simhash.fingerprint(odd_texts[-1]) == want


@pytest.mark.parametrize(("pairwise", "wide"), [(1, 1 << 26), (16, 1 << 26), (16, 0)])
def test_links_join_what_all_pairs_join(spark, pairwise, wide):
    rng = random.Random(5)
    prints = {0, 7}
    for _ in range(25):  # groups about a centre, and chains away from it
        p = rng.getrandbits(64)
        for _ in range(rng.choice([2, 5, 40])):
            prints.add(p)
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                q ^= 1 << b
            p = rng.choice([p, q])
            prints.add(q)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame(list(enumerate(signed)), "node long, print long"), 4, pairwise, wide).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in links)
    every = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert components_of(range(len(prints)), [tuple(r) for r in links]) == components_of(range(len(prints)), every)


def test_long_lists_give_few_links():
    centre = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(np.array([centre ^ np.uint64((1 << a) | (1 << b)) for a in range(32) for b in range(32)], np.uint64))
    links = simhash.list_links(prints, 4, 4)
    assert len(links) == len(prints) - 1


def test_the_count_drops_pairs_before_bits_are_compared():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in rng.integers(0, 12, 4000)]
    b = a ^ np.array(flips, np.uint64)
    shared = [sum(x == y for x, y in zip(int(p).to_bytes(8), int(q).to_bytes(8), strict=True)) for p, q in zip(a, b, strict=True)]
    assert simhash.tally(a, b).tolist() == shared
    dropped = sum(s < 4 for s in shared)
    differing = [(int(p) ^ int(q)).bit_count() for p, q in zip(a, b, strict=True)]
    assert 500 < dropped < 3500 and any(s >= 4 and d > 4 for s, d in zip(shared, differing, strict=True))
    assert simhash.verified(a, b, 4, 4).tolist() == [i for i, d in enumerate(differing) if d <= 4]
    assert simhash.verified(a, b, 64, 4).tolist() == [i for i, s in enumerate(shared) if s >= 4]


def test_a_long_list_is_split_over_tasks(spark):
    """Members that share a triple of bytes, most of them unlinked, go on to lists of four bytes."""
    rng = random.Random(11)
    prints = {0xABCDEF << 40 | rng.getrandbits(40) for _ in range(1500)}
    prints |= {p ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for p in rng.sample(sorted(prints), 300)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, print long")
    every = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = components_of(range(len(prints)), every)
    for longest in (1 << 14, 100, 10):
        links = simhash.near_links(nodes, longest=longest).collect()
        assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in links)
        assert components_of(range(len(prints)), [tuple(r) for r in links]) == want

    def stream(size):
        key = np.zeros(len(prints), np.int64)
        held = np.array(prints, np.uint64)
        for i in range(0, len(prints), size):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(held[i : i + size].view(np.int64)), pa.array(np.arange(len(prints))[i : i + size])], names=["key", "print", "node"])

    for size in (7, 100, 4000):
        found = pa.Table.from_batches(simhash._linked(stream(size), 4, 4, 16, 100))
        assert sorted(found.column("a").to_pylist()) == list(range(len(prints))) and found.column("b").null_count == len(found)


def test_near_duplicates(spark, odd_docs, odd_texts, no_docs):
    more = [(500, None), (501, None), (20, odd_texts[20]), (None, odd_texts[21]), (None, "only here without an id")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = simhash.near_duplicates(docs).collect()
    texts = dict(enumerate(odd_texts)) | {500: None, 501: None}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    want = components_of(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r.doc_id is not None:
            assert r.print % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert sorted((r.component_id for r in rows if r.doc_id is None), key=str) == [21, None]
    kept = simhash.kept(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.kept(no_docs).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    text = lambda seed: " ".join(random.Random(seed).choices("ab cd ef gh ij kl mn op qr st uv wx yz".split(), k=60))
    a, b, c, d, e = map(text, range(5))
    rows = [(3, a), (1, b), (2, a), (3, b), (None, a), (None, c), (None, c), (7, d), (7, e), (7, e.upper()), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {(2, a), (1, b), (None, c), (7, d), (7, e.upper()), (None, None)}
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 6
    named = {(r.doc_id, r.print % (1 << 64)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert named[3, simhash.fingerprint(a)] == 2 and named[3, simhash.fingerprint(b)] == 1
    assert named[None, simhash.fingerprint(a)] == 2 and named[None, simhash.fingerprint(c)] is None


# ---- embeddings


def vectors():
    rng = np.random.default_rng(0)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=(6, 16))
        for c in centre:
            for _ in range(rng.integers(1, 40)):
                rows.append(((c + rng.normal(size=16) * rng.choice([0.01, 0.12])).tolist(), label))
    rows += [(rows[0][0], 0)] * 3 + [(rows[0][0], 1), ([2 * x for x in rows[0][0]], 0)]
    rows += [(rng.normal(size=16).tolist(), 1) for _ in range(150)]
    rows += [([1.0, 2.0], 1), ([1.0, 2.001], 1), ([1.0], 1)]
    odd = [(None, 1), ([], 1), ([0.0] * 16, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), (rows[0][0], None), (rows[0][0], None)]
    return [(i, v, label) for i, (v, label) in enumerate(rows + odd)], len(rows)


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, block):
    rows, sound = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, weight int")
    got = {r.vec_id: r for r in pqdedup.near_duplicates(df, block=block).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows[:sound]]
    links = [(i, j) for i, j in combinations(range(sound), 2) if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    want = components_of(range(len(rows)), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(got) == len(rows) and len(links) > 300
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], want[i], want[i] == i)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_cosine_of_exactly_the_threshold_links(spark, kind):
    """(49, 7, 7, 1) has length 50 and cosine 0.98 with the first axis, to the last bit."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [49.0, 7.0, 7.0, 1.0]), (3, [49.0, 7.0, 7.0, 1.5]), (4, [-49.0, 7.0, 7.0, 1.0]), (5, [3.0, 0.0, 0.0, 0.0]), (6, [49.0, -7.0, 7.0, -1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pqdedup.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (1, 1), 4: (0, 4), 5: (3, 1), 6: (2, 1)}


def test_embeddings_of_a_hot_list(spark):
    """A third of all vectors near one direction, in blocks far smaller than their list: links and counts are whole."""
    rng = np.random.default_rng(7)
    hot = np.eye(8)[0] + rng.normal(size=(200, 8)) * 0.1
    rest = rng.normal(size=(400, 8))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.vstack([hot, rest]))]
    unit = np.array([v for _, v, _ in rows]) / np.linalg.norm([v for _, v, _ in rows], axis=1)[:, None]
    links = [(i, j) for i, j in combinations(range(600), 2) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.98]
    want, n = components_of(range(600), links), np.bincount(np.array(links).ravel(), minlength=600)
    for kind, block in (("double", 32), ("double", 16384)):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in pqdedup.near_duplicates(df, block=block).collect()}
        assert got == {i: (n[i], want[i]) for i in range(600)}


def test_embeddings_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pqdedup.near_duplicates(none).count() == 0
    some = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    rows = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pqdedup.near_duplicates(some).collect()), key=str)
    assert rows == [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, False)]


def test_quantiser_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.02
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    q = pqdedup.Quantiser.fit(x, 12)
    own, _, codes, err = q.encode(y, 0.2)
    _, probed, _, _ = q.encode(x, 0.2)
    far = np.linalg.norm(x - y, axis=1)
    for i in np.flatnonzero(far <= 0.2):
        assert probed[i, own[i]]
        assert q.distances(x[i : i + 1], own[i], codes[i : i + 1])[0, 0] <= far[i] + err[i] + pqdedup.SLACK
