"""BPE with word ends by prefix-sharing trie traversal.

A text's words are those of the tokenizer file's own normalizer and splitter. The
distinct words of a block that the worker has not met yet form a trie, held as their
sorted list with common prefix lengths. It is walked depth first: each prefix carries
the last token of its own encoding, found once from the shorter prefixes' last tokens
(the one token that ends there and that BPE would leave unmerged beside the last token
before it), so words that share a prefix share its encoding. At a word's end the last
token is one of those that close a word, and following the last tokens backwards gives
its ids. Whether BPE leaves two tokens unmerged side by side is decided by undoing
their merges from the latest on.

A null text counts as empty and has no tokens; texts are encoded whole; repeated rows
are encoded alike; an empty table gives nothing; other columns are kept, those named
as the operator's own replaced. What a worker remembers is bounded by `MEMO` words.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from parcelwise.llm.bytebpe import byte_letters
from parcelwise.llm.common import by_blocks, renamed, small_batches

MEMO = 200_000
WORD_BYTES = 1 << 20  # of text whose words are held at once
# The file's splitter, for texts of ASCII and of Latin letters below U+0250 in lower case.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
LATIN_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
BEYOND = re.compile("[^\x00-ɏ]")


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or spec["decoder"]:
            raise ValueError(f"{path} is no BPE file with word ends and without a decoder")
        vocab = model["vocab"]
        self.path = path
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.merged: dict[int, int] = {}
        self.split = {i: (i, i) for i in vocab.values()}
        for left, right in model["merges"]:
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a << 20 | b], self.split[c] = c, (a, b)
        order = [vocab[left + right] for left, right in model["merges"]]
        if order != sorted(order) or len(set(order)) < len(order):
            raise ValueError(f"{path} does not number its tokens in the order of its merges")
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            body, own = (token[: -len(end)], self.final) if token.endswith(end) and token != end else (token, self.inner)
            own[bytes(self.letters[c] for c in body)] = i
        self.longest = max(map(len, chain(self.inner, self.final)))
        self.apart: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, for the texts that need its normalizer; most workers never load it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE never merges across the border of the tokens a and b, side by side."""
        key = a << 20 | b
        known = self.apart.get(key)
        if known is not None:
            return known
        limit, out = 1 << 30, None
        while out is None:
            if self.merged.get(a << 20 | b, limit) < limit:
                out = False
            elif a > b:  # a's last merge came later: undo it
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    out = True if b + 1 == limit else None
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    out = True if a == limit else None
        if len(self.apart) > 2 * MEMO:
            self.apart.clear()
        self.apart[key] = out
        return out

    def last_token(self, word: bytes, end: int, last: list[tuple[int, int]], tokens: dict[bytes, int]) -> tuple[int, int]:
        """(id, length) of the last token of word[:end], from those of the shorter prefixes."""
        for start in range(max(0, end - self.longest), end):
            token = tokens.get(word[start:end])
            if token is not None and (not start or self.stay_apart(last[start][0], token)):
                return token, end - start
        raise ValueError(word)

    def traverse(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of distinct words in ascending order."""
        out, before = [], b""
        last: list[tuple[int, int]] = [(-1, 0)]
        for word in words:
            n, shared = len(word), 0
            most = min(n - 1, len(last) - 1)
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n):
                last.append(self.last_token(word, end, last, self.inner))
            token, size = self.last_token(word, n, last, self.final)
            ids, at = [token], n - size
            while at:
                token, size = last[at]
                ids.append(token)
                at -= size
            out.append(tuple(reversed(ids)))
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens; of some texts only the file's own splitter knows them."""
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        if not BEYOND.search(text):
            return LATIN_WORD.findall(unicodedata.normalize("NFC", text).lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in piece).decode() for piece, _ in pieces]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        rows = []
        for text in texts:
            if text and "<|" in text:
                rows.append([y for x in self.specials.split(text) for y in ([x] if x in self.special else self.words(x))])
            else:
                rows.append(self.words(text) if text else [])
        new = set().union(*rows)
        new.difference_update(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*rows)
        new -= self.special.keys()
        by = {w.encode(): w for w in new}
        ordered = sorted(by)
        for word, ids in zip(ordered, self.traverse(ordered), strict=True):
            self.memo[by[word]] = ids
        self.memo |= {name: (i,) for name, i in self.special.items()}
        get = self.memo.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, row)), np.int32) for row in rows]


@cache
def bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(batches, path: str):
    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        ids = bpe(path).encode_batch(block.column(block.schema.get_field_index("text")).to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return renamed(block, ids=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    yield from by_blocks(batches, "text", one, WORD_BYTES)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids`, the array of each text's token ids. No exchange."""
    fields = [f for f in docs.schema.fields if f.name != "ids"]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return small_batches(docs).select(*(f"`{f.name}`" for f in fields)).mapInArrow(lambda it: _encoded(it, path), schema)


def _decoded(batches, path: str):
    names = pa.array(bpe(path).names)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        tokens = pa.ListArray.from_arrays(ids.offsets, names.take(ids.values))
        yield renamed(batch, decoded=pc.binary_join(tokens, " "))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """A table with `ids`, and `decoded`: the tokens' strings joined by spaces, as a file without a decoder says."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())])
    return encoded.select(*(f"`{f.name}`" for f in fields)).mapInArrow(lambda it: _decoded(it, path), schema)
