"""The pipeline's stages against a plain version of each, on the small table and on odd rows."""

import re
from itertools import combinations

import pytest

import corpus_pipeline
from parcelwise.llm import quality, secretscan, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_kept(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1}
    inside = {p for i, w in enumerate(windows) if w in many for p in range(i, i + 8)}
    good = []
    for line in text.split("\n"):
        solid = re.sub(r"[\x20\x09-\x0D]", "", line)
        marks = len(re.findall(quality.PUNCTUATION, solid))
        bad = re.search(quality.MENU, line) or re.search(quality.BOILERPLATE, line.lower()) or (marks >= 4 and 100 * marks > 30 * len(solid))
        good += [] if bad else [line]
    solid = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))
    kept = len(words) >= 20 and 100 * len(inside) <= 30 * len(words) and 100 * (solid(text) - solid("\n".join(good))) <= 50 * solid(text)
    return "\n".join(good) if kept else None


def plain_redacted(text):
    spans = []
    for rule in secretscan.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at or (a == at == 0) or a == at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def one_of_each(prints):
    part = {i: i for i in prints}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = find(a), find(b)
            part[max(a, b)] = min(a, b)
    return {i for i in prints if find(i) == i}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "secret_scan", "packing"]


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == COLUMNS
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            want = {i: c for i, t in want.items() if (c := plain_kept(t)) is not None}
        elif name == "near_dedup":
            left = one_of_each({i: simhash.fingerprint(t) for i, t in want.items()})
            want = {i: want[i] for i in left}
        elif name == "secret_scan":
            want = {i: plain_redacted(t) for i, t in want.items()}
        assert {i: r.text for i, r in got.items()} == want, name
        assert all(r.n_chars == len(r.text) for r in got.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(want)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, empty):
    docs = no_docs if empty else odd_docs.select(*COLUMNS).unionByName(spark.createDataFrame([(None, "a text without an id " * 9, None, None, None), (5, None, None, None, None)], no_docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        n = docs.count()
    assert n == 0 if empty else n > 0


def test_rows_of_odd_documents(spark, odd_docs, no_docs):
    """Which rows each stage keeps of nulls, blanks, repeats, repeated and missing ids, by number."""
    long = " ".join(f"the boat{i} of harbour{i * 7} went by" for i in range(30))
    other = " ".join(f"many people{i} read a story{i * 3} again" for i in range(30))
    secret = f"{other} password = abcdefgh12"
    rows = [(1, long), (1, long), (None, long), (None, other), (None, other), (2, other), (2, secret), (3, None), (3, None), (None, None), (4, ""), (5, " \n\t"), (6, "12 34"), (7, "the boat"), (8, long + " | x")]
    docs = spark.createDataFrame([(i, t, None if i == 1 else "en", None, None) for i, t in rows], no_docs.schema)
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    order = lambda x: sorted(x, key=repr)
    docs = corpus_pipeline.language_id(spark, docs, SF).cache()
    wordy = [(i, t) for i, t in rows if t and re.search("[a-z]", t)]
    assert found(docs) == order(wordy)
    docs = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    enough = [(i, t) for i, t in wordy if t != "the boat"]
    assert found(docs) == order(enough) and all(r.n_chars == len(r.text) for r in docs.collect())
    docs = corpus_pipeline.near_dedup(spark, docs, SF).cache()
    prints = {t: simhash.fingerprint(t) for _, t in enough}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    assert near(long, long + " | x") and not near(other, long)
    kept = [(1, long), (2, other)] + ([] if near(other, secret) else [(2, secret)])
    assert found(docs) == order(kept)
    docs = corpus_pipeline.secret_scan(spark, docs, SF).cache()
    assert found(docs) == order([(i, plain_redacted(t)) for i, t in kept])
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {1, 2} and all(r.length == r.doc_tokens for r in packed) and len(packed) == len(kept)
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.secret_scan):
        odd = stage(spark, spark.createDataFrame([(3, None, None, None, None), (None, None, "en", None, 5), (4, "", "en", "s", 0)], no_docs.schema), SF)
        assert found(odd) == ([(3, None)] if stage is corpus_pipeline.near_dedup else [(3, None), (4, ""), (None, None)])
    blank = corpus_pipeline.pack(spark, spark.createDataFrame([(None, None, None, None, None), (4, "", "en", "s", 0)], no_docs.schema), SF).collect()
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in blank) == [("4", 1, 1), ("None", 1, 1)]
