"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A shard file holds, in this order: the ids (2 bytes each if they fit, else 4, little
endian), the boundaries and the document ids as two Elias-Fano sequences, a JSON
footer, its length (8 bytes) and MAGIC. Boundaries are the offsets at which the
documents begin and the last one ends; `EliasFano.select` gives one of them from the
bit vectors and a sampled select directory, without a table of 64-bit offsets. Readers find
the borders of a block of documents by selects, and the offsets inside it by a walk from there.

Rows are sorted by doc_id (nulls first), then text. Null texts count as empty, repeated
rows are written once for each row, an empty table gives no shard. Text length is
bounded by one Arrow string only; a shard rolls over after `shard_tokens` ids or
`shard_docs` documents, so that memory is bounded however the ids are dealt.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.bytebpe import encode
from parcelwise.llm.common import row_blocks, small_batches
from parcelwise.session import shared_dir

MAGIC = b"EFIDS001"
SAMPLE = 256
MANIFEST = "path string, first_doc long, n_docs long, n_tokens long, n_null long"
READ = "doc_id long, start long, n_tokens long, ids binary"


class EliasFano:
    """A non-decreasing sequence of n integers below or at `top` in n * (2 + log2(top / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        line = np.zeros((int(high[-1]) // 8 + 1) * 8 if n else 0, np.uint8)
        line[high] = 1
        low = bytearray()
        for i in range(0, n, 1 << 16):  # a multiple of 8 values, so that parts end on bytes
            part = (v[i : i + (1 << 16), None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low += np.packbits(part.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, bytes(low), np.packbits(line, bitorder="little").tobytes(), high[::SAMPLE].astype("<u8"))

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop (exclusive): a walk along the bit vector from the sampled position before start."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first, behind = start // SAMPLE, (stop - 1) // SAMPLE + 1
        at = int(self.samples[first]) // 8
        end = int(self.samples[behind]) // 8 + 1 if behind < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, offset=at, count=end - at), bitorder="little")) + at * 8
        skip = start - first * SAMPLE + int(np.searchsorted(ones, self.samples[first]))
        out = (ones[skip : skip + stop - start] - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = start * self.low_bits
            end = ((stop * self.low_bits) + 7) // 8
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8, offset=bit // 8, count=end - bit // 8), bitorder="little")
            part = bits[bit % 8 :][: (stop - start) * self.low_bits].reshape(-1, self.low_bits)
            for b in range(self.low_bits):
                out |= part[:, b].astype(np.uint64) << np.uint64(b)
        return out

    def decode(self) -> np.ndarray:
        """All values, by walks of bounded length."""
        step = 1 << 16
        return np.concatenate([self.values(i, min(i + step, self.n)) for i in range(0, self.n, step)] or [np.zeros(0, np.uint64)])

    def select(self, i: int) -> int:
        """Value i: the sampled position of an earlier one, then at most SAMPLE ones further."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at // 8, self.high[at // 8] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8 + 1], "little")
        return high << self.low_bits | (raw >> first % 8) & ((1 << self.low_bits) - 1)

    def parts(self) -> tuple[dict, bytes]:
        body = self.low + self.high + self.samples.tobytes()
        return {"n": self.n, "bits": self.low_bits, "low": len(self.low), "high": len(self.high), "samples": len(self.samples)}, body

    @classmethod
    def load(cls, about: dict, body: bytes) -> EliasFano:
        a, b = about["low"], about["low"] + about["high"]
        return cls(about["n"], about["bits"], body[:a], body[a:b], np.frombuffer(body, "<u8", offset=b, count=about["samples"]))


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder's URI, local, HDFS or object store."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class ShardWriter:
    """Writes one shard; ids are streamed out, only lengths and doc ids stay in memory, 8 bytes each."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width
        system, path = place(uri)
        self.out = system.open_output_stream(path)
        self.lengths, self.docs = array("q"), array("q")
        self.n_null = self.n = 0

    def __len__(self) -> int:
        return len(self.lengths)

    def add(self, docs: pa.Array, ids: list[np.ndarray]) -> None:
        """Rows in ascending order of doc_id, nulls first."""
        self.lengths.extend(map(len, ids))
        self.n_null += docs.null_count
        self.docs.frombytes(docs.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
        flat = np.concatenate(ids)
        self.out.write(flat.astype(f"<u{self.width}").tobytes())
        self.n += len(flat)

    def close(self) -> tuple:
        docs = np.frombuffer(self.docs, np.int64) if self.docs else np.zeros(0, np.int64)
        first = int(docs[0]) if len(docs) else None
        bounds = EliasFano.build(np.concatenate([[0], np.cumsum(np.frombuffer(self.lengths, np.int64))]))
        keys = EliasFano.build(docs.astype(np.uint64) - np.uint64(np.int64(first or 0).astype(np.uint64)))
        footer = {"width": self.width, "n_tokens": self.n, "first_doc": first, "n_null": self.n_null}
        for name, seq in (("bounds", bounds), ("docs", keys)):
            footer[name], body = seq.parts()
            footer[name]["at"], footer[name]["size"] = self.out.tell(), len(body)
            self.out.write(body)
        tail = json.dumps(footer).encode()
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
        self.out.close()
        return self.uri, first, len(self), self.n, self.n_null


class Shard:
    """A shard file opened for reading."""

    def __init__(self, uri: str):
        system, path = place(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token-id shard")
        self.about = json.loads(self.file.read_at(length, size - 16 - length))
        self.width = self.about["width"]
        self.bounds, keys = (EliasFano.load(x, self.file.read_at(x["size"], x["at"])) for x in (self.about["bounds"], self.about["docs"]))
        self.keys = keys

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_ids(self, start: int = 0, stop: int | None = None) -> pa.Array:
        """Document ids of the rows start to stop."""
        stop, nulls = len(self) if stop is None else stop, self.about["n_null"]
        known = self.keys.values(max(0, start - nulls), max(0, stop - nulls)) + np.uint64(np.int64(self.about["first_doc"] or 0).astype(np.uint64))
        none = pa.nulls(max(0, min(stop, nulls) - start), pa.int64())
        return pa.concat_arrays([none, pa.array(known.astype(np.int64))])

    def block(self, start: int, most: int) -> int:
        """The row behind the last one from `start` that ends within `most` ids, one row at least; by selects alone."""
        from_id, low, high = self.bounds.select(start), start + 1, len(self)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.bounds.select(middle) - from_id <= most else (low, middle - 1)
        return low

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids by token offset."""
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def _written(batches, tokenizer: str, end_id: int, folder: str, width: int, shard_tokens: int, shard_docs: int):
    writer = None
    made = []
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1)
        for start, stop in row_blocks(texts):
            ids = [np.append(encode(tokenizer, t.as_py()), np.uint32(end_id)) for t in texts.slice(start, stop - start)]
            writer = writer or ShardWriter(f"{folder}/{uuid.uuid4().hex}.efids", width)
            writer.add(docs.slice(start, stop - start), ids)
            if writer.n >= shard_tokens or len(writer) >= shard_docs:
                made.append(writer.close())
                writer = None
    if writer:
        made.append(writer.close())
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    types = [pa.string()] + [pa.int64()] * 4
    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=names)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, shard_tokens: int = 1 << 24, shard_docs: int = 1 << 22) -> list[dict]:
    """Encodes the texts of docs (doc_id, text), writes shards in ascending doc_id order, returns their manifest.

    The text crosses one range exchange and is encoded once behind it. A retried task
    writes files of other names; only those that the manifest names count. The manifest
    has a row for each shard of about 16 million ids or 4 million documents, so the driver can hold it.
    """
    from parcelwise.llm.bytebpe import encoder

    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    width = 2 if max(encoder(tokenizer).max_token_value, end_id) < 1 << 16 else 4
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(lambda it: _written(it, tokenizer, end_id, folder, width, shard_tokens, shard_docs), MANIFEST).collect()
    order = sorted(made, key=lambda r: (r.n_null == 0, r.first_doc if r.first_doc is not None else -(1 << 63)))
    out, start = [], 0
    for r in order:
        out.append(r.asDict() | {"start": start})
        start += r.n_tokens
    return out


def _read(batches, read_tokens: int):
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard, i = Shard(path), 0
            while i < len(shard):
                j = shard.block(i, read_tokens)
                bounds = shard.bounds.values(i, j + 1).astype(np.int64)
                ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                cuts = (bounds - bounds[0]) * 4
                column = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([shard.doc_ids(i, j), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), column], names=names)
                i = j


def read_tokens(spark, manifest: list[dict], block: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens and ids (32-bit little endian) of every document in the shards."""
    rows = [(m["path"], m["start"]) for m in manifest]
    parts = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return parts.mapInArrow(lambda it: _read(it, block), READ)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
