import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelwise.llm import bytebpe, packing, tokenfile, wordbpe

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_both_encoders_equal_the_library(text):
    byte, word = LIBRARY
    assert bytebpe.encode(BYTES, text).tolist() == ids_of(byte, text)
    assert wordbpe.bpe(WORDS).encode_batch([text])[0].tolist() == ids_of(word, text)


LIBRARY = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_every_vocabulary_entry_is_encoded_as_the_library_does():
    """All printable entries of the byte-level file, and as many random joins of two or three of them."""
    letters = bytebpe.byte_letters()
    entries = []
    for token in LIBRARY[0].get_vocab():
        try:
            entries.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    rng = random.Random(0)
    texts = entries + ["".join(rng.choices(entries, k=rng.choice((2, 3)))) for _ in range(len(entries))]
    assert len(entries) > 45_000
    for text, found in zip(texts, LIBRARY[0].encode_batch(texts, add_special_tokens=False), strict=True):
        assert bytebpe.encode(BYTES, text).tolist() == found.ids, text


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000 + "x", "a" * 300_000, "é#" * 100_000])
def test_very_long_runs(text):
    assert bytebpe.encode(BYTES, text).tolist() == ids_of(LIBRARY[0], text)
    assert wordbpe.bpe(WORDS).encode_batch([text])[0].tolist() == ids_of(LIBRARY[1], text)


def test_latin_letters_equal_the_library(library):
    rng = random.Random(3)
    pool = [chr(c) for c in range(1, 0x250) if not 0xD800 <= c < 0xE000] + ["'s", "'LL", " ", "\n", "<|endoftext|>", "Σ"]
    bpe = wordbpe.bpe(WORDS)
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(40))
        assert bpe.encode_batch([text])[0].tolist() == ids_of(library[1], text)


def test_every_token_encodes_to_itself():
    bpe = wordbpe.bpe(WORDS)
    words = sorted(w for w in bpe.final if w)
    for word, ids in zip(words, bpe.traverse(words), strict=True):
        assert ids == (bpe.final[word],)


def test_word_bpe_round_trip(spark, odd_docs, odd_texts, no_docs, library):
    done = wordbpe.decode(wordbpe.encode(odd_docs, WORDS), WORDS)
    for r in done.collect():
        ids = ids_of(library[1], odd_texts[r.doc_id])
        assert r.ids == ids and r.decoded == library[1].decode(ids, skip_special_tokens=False)
        assert r.source == "src0"
    assert wordbpe.encode(no_docs, WORDS).count() == 0


def test_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr(wordbpe, "MEMO", 5)
    bpe = wordbpe.WordBpe(WORDS)
    texts = ["one two three", "four five six seven", "one two <|endoftext|> nine", "four"]
    for t in texts:
        assert bpe.encode_batch([t])[0].tolist() == ids_of(library[1], t)
        assert len(bpe.memo) <= 5 + 4 + 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 50), max_size=700))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    seq = tokenfile.EliasFano.build(values)
    about, body = seq.parts()
    seq = tokenfile.EliasFano.load(about, body)
    assert seq.decode().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert seq.select(i) == values[i]
    with pytest.raises(IndexError):
        seq.select(len(values))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=1500), st.integers(0, 1500), st.integers(0, 1500))
def test_a_walk_gives_any_stretch(values, a, b):
    values = np.sort(np.array(values, np.uint64))
    a, b = sorted((a % len(values), b % (len(values) + 1)))
    seq = tokenfile.EliasFano.build(values)
    assert seq.values(a, b).tolist() == values[a:b].tolist()


def test_reading_never_decodes_a_sequence_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile.EliasFano, "decode", None)
    walked = []
    walk = tokenfile.EliasFano.values
    monkeypatch.setattr(tokenfile.EliasFano, "values", lambda self, a, b: walked.append(b - a) or walk(self, a, b))
    writer = tokenfile.ShardWriter(f"file://{tmp_path}/x", 2)
    docs, rng = pa.array([None] * 5 + list(range(-10, 2000)), pa.int64()), np.random.default_rng(0)
    ids = [rng.integers(0, 1 << 16, n, np.uint32) for n in rng.integers(1, 40, len(docs))]
    ids[7] = np.arange(5000, dtype=np.uint32)
    for i in range(0, len(docs), 300):
        writer.add(docs.slice(i, 300), ids[i : i + 300])
    path, first, n_docs, n_tokens, n_null = writer.close()
    assert (first, n_docs, n_tokens, n_null) == (-10, len(docs), sum(map(len, ids)), 5)
    batch = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([100])], names=["path", "start"])
    found = pa.Table.from_batches(tokenfile._read([batch], 1000))
    assert found.column("doc_id").to_pylist() == docs.to_pylist()
    assert [np.frombuffer(x, "<u4").tolist() for x in found.column("ids").to_pylist()] == [x.tolist() for x in ids]
    assert found.column("start").to_pylist() == (100 + np.cumsum([0, *map(len, ids)])[:-1]).tolist()
    assert max(walked) < 300


def test_many_empty_documents(spark, tmp_path):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    made = tokenfile.write_tokens(docs, BYTES, 0, f"file://{tmp_path}/m", shard_docs=4000)
    assert sum(m["n_docs"] for m in made) == 30_000 and max(m["n_docs"] for m in made) < 15_000
    got = tokenfile.read_tokens(spark, made)
    assert got.where("start <> doc_id or n_tokens <> 1").count() == 0 and got.count() == 30_000


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000)).astype(np.uint64)
    _, body = tokenfile.EliasFano.build(values).parts()
    assert 8 * len(body) / len(values) < 2 + np.log2(1000) + 1.5


@pytest.mark.parametrize("shard_tokens", [1 << 24, 50])
def test_token_files(spark, odd_docs, odd_texts, no_docs, library, tmp_path, shard_tokens):
    docs = odd_docs.select("doc_id", "text").unionByName(odd_docs.where("doc_id = 20").select("doc_id", "text")).unionByName(spark.createDataFrame([(None, "null id"), (-5, "minus")], "doc_id long, text string"))
    made = tokenfile.write_tokens(docs, BYTES, 0, f"file://{tmp_path}/t", shard_tokens)
    got = sorted(tokenfile.read_tokens(spark, made).collect(), key=lambda r: r.start)
    want = sorted([(i, t) for i, t in enumerate(odd_texts)] + [(20, odd_texts[20]), (None, "null id"), (-5, "minus")], key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = [*ids_of(library[0], text), 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    shard = tokenfile.Shard(made[-1]["path"])
    assert shard.document(len(shard) - 1).tolist() == [*ids_of(library[0], odd_texts[-1]), 0]
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(no_docs, BYTES, 0, f"file://{tmp_path}/e")).count() == 0


def checked_packing(rows, want, window):
    for doc, ids in want.items():
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 for r in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(by) == list(range(len(by)))
    return sum(r.length for r in rows) / (window * len(by))


def test_packing(spark, odd_docs, odd_texts, no_docs, library):
    want = {i: [*ids_of(library[0], t), 1] for i, t in enumerate(odd_texts)}
    rows = packing.pack(odd_docs, BYTES, 1, 256).collect()
    assert checked_packing(rows, want, 256) > 0.9
    assert packing.pack(no_docs, BYTES).count() == 0


def test_packing_of_equal_documents(spark, library):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text")).repartition(7)
    want = {i: [*ids_of(library[0], "the same text"), 1] for i in range(300)}
    assert checked_packing(packing.pack(docs, BYTES, 1, 64).collect(), want, 64) > 0.9


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=20))
def test_plans_use_the_histogram_exactly(found):
    counts = np.zeros(65, np.int64)
    for k, n in found.items():
        counts[k] = n
    used = np.zeros(65, np.int64)
    for lengths, n in packing.pack_plan(counts, 64):
        assert sum(lengths) <= 64 and n > 0
        for k in lengths:
            used[k] += n
    assert used.tolist() == counts.tolist()


def test_plan_wastes_little():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2048, 100_000), minlength=2049)
    plan = packing.pack_plan(counts, 2048)
    assert (counts * np.arange(2049)).sum() / (2048 * sum(n for _, n in plan)) > 0.99
    assert len(plan) < 12_000


def test_nnls_solves_a_small_system():
    columns, uses = np.array([[1, 2], [2, 3], [3, 0]]), np.array([[1.0, 1.0], [1.0, 1.0], [2.0, 0.0]])
    x = packing.nnls(columns, uses, np.array([0, 4, 6, 8]), 500, 1e-9)
    assert np.allclose(x, [4, 2, 3], atol=0.1) and (x >= 0).all()
