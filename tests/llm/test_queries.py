"""The registered corpus queries on the small tables: against SQL where there is some, else against brute force."""

import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from parcelwise.llm import queries

SF = "/root/testdata/sf0.001"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, links):
    part = {n: n for n in nodes}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("select doc_id, text from documents").fetchall())


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    rows = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rows.fetchall(), columns)


def test_language_of_held_out_documents(spark, db):
    langs = dict(db.execute("select doc_id, lang from documents").fetchall())
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(texts)
    return dict(zip(order, (e.ids for e in tokenizer.encode_batch([texts[i] or "" for i in order], add_special_tokens=False)), strict=True))


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_token_file(spark, ids):
    start = 0
    for r, doc in zip(sorted(queries.op2_token_file(spark, SF).collect(), key=lambda r: r.doc_id), sorted(ids), strict=True):
        own = [*ids[doc], 0]
        assert tuple(r) == (doc, start, len(own), crc(own))
        start += len(own)


def test_packing(spark, ids):
    rows, seen = queries.op10_packing(spark, SF).collect(), {}
    for r in rows:
        own = [*ids[r.doc_id], 1]
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length]) and r.doc_tokens == len(own)
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids.values())
    for own in seen.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_word_bpe(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = queries.op7_word_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(own), sha256(" ".join(map(str, own))))
        assert r.decoded_sha256 == sha256(library.decode(own, skip_special_tokens=False))


def test_simhash(spark, texts):
    prints = {i: plain_print(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components_of(prints, links)
    rows = queries.op8_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()} and len(rows) == len(texts)


def test_registered_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
