"""Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

The file is the library's own JSON. Its merges are run by tiktoken, whose ranks are
the ids of that same file: the library alone needs about 600 CPU seconds for a GB of
the test documents, tiktoken about 110. Tests hold both against each other.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the splitting pattern of byte-level BPE files with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer in `path`, loaded once in each worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level BPE file")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def library(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def encode(path: str, text: str | None) -> np.ndarray:
    """The ids of a whole text; strings of special tokens in it become those tokens.

    tiktoken's splitter gives up with a ValueError on white space of some hundred
    thousand characters in a row; such a text goes to the library itself.
    """
    if not text:
        return np.zeros(0, np.uint32)
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)
