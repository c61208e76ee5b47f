"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined, in Spark, to the k-grams
of the license templates (a fixed table, broadcast). A match votes for its text,
template and diagonal, which is the gram's place in the text less its place in the
template. Votes are counted by diagonal; neighbouring diagonals of a template (words put
in or left out) are merged; spans are kept if their grams, verified against the template
by a second, independent 64-bit hash of their words, cover enough of it. A phrase template
must be met in full on a single diagonal, so its spans are exactly the places where its
words stand consecutively. Texts stay in the function that hashes them: only numbers reach
the join, and time is linear in a text's words and places.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII
characters. A null text counts as empty and has no words; repeated rows are scanned
each; a null doc_id is kept; an empty table gives nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import by_blocks, small_batches, text_buffers


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    k: int
    base: bool = False
    least: float = 1.0  # the share of its grams that a span must meet


# The base phrases and their labels, then openings of well-known licenses.
TEMPLATES = (
    Template("cc-by", "cc by", 2, True),
    Template("gpl", "general public license", 2, True),
    Template("reserved", "all rights reserved", 2, True),
    Template("apache", "licensed under the apache license version 2 0", 4, least=0.5),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, least=0.5),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 4, least=0.5),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", 4, least=0.5),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 4, least=0.5),
    Template("mit", "released under the mit license", 4),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", 4, least=0.5),
)
SIZES = (2, 4)
DOC = -1  # the gram that stands once for each text, so that texts without a match stay
NEAR = 3  # diagonals this close together are one span
GRAMS = "row long, doc_id long, n_words long, grams array<struct<gram:long,check:long>>"
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BASES = np.uint64(0x100000001B3), np.uint64(0x2545F4914F6CDD1D)
POWERS = 1 << 16

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


@cache
def _powers(which: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(POWERS, BASES[which]), dtype=np.uint64)


def words_of(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(text, first byte, two 64-bit hashes) of every word of a block of texts."""
    low = _LOW[raw]
    inside = _WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offs[:-1][offs[:-1] < len(raw)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, (starts.astype(np.uint64),) * 2
    place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    hashes = []
    with np.errstate(over="ignore"):
        for which, mix in enumerate(MIX):
            h = np.add.reduceat(np.where(inside, _powers(which)[place & (POWERS - 1)] * (low + np.uint64(1)), np.uint64(0)), starts)
            h = (h ^ h >> np.uint64(29)) * mix
            hashes.append(h ^ h >> np.uint64(32))
    return np.searchsorted(offs, starts, "right") - 1, starts, tuple(hashes)


def grams_of(text: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(text, two hashes) of every run of k words within one text."""
    n = max(0, len(text) - k + 1)
    whole = text[:n] == text[k - 1 :][:n]
    out = []
    with np.errstate(over="ignore"):
        for words, mix in zip(hashes, MIX, strict=True):
            h = np.full(n, k, np.uint64)
            for j in range(k):
                h = (h ^ words[j : j + n]) * mix
                h ^= h >> np.uint64(31)
            out.append(h[whole].view(np.int64))
    return text[:n][whole], tuple(out)


def _grams(batches):
    part, row = TaskContext.get().partitionId() << 40, 0
    names = ["row", "doc_id", "n_words", "grams"]

    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal row
        text, _, hashes = words_of(*text_buffers(block.column(1)))
        n_words = np.bincount(text, minlength=len(block))
        parts = [grams_of(text, hashes, k) for k in SIZES]
        owner = np.concatenate([np.arange(len(block)), *(p[0] for p in parts)])
        order = np.argsort(owner, kind="stable")
        values = [pa.array(np.concatenate([np.full(len(block), DOC, np.int64), *(p[1][i] for p in parts)])[order]) for i in range(2)]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(block)))]).astype(np.int32)
        rows = np.arange(part + row, part + row + len(block))
        row += len(block)
        grams = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, ["gram", "check"]))
        return pa.RecordBatch.from_arrays([pa.array(rows), block.column(0), pa.array(n_words.astype(np.int64)), grams], names=names)

    yield from by_blocks(batches, "text", one)


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(gram, check, template, k, place): one row for each gram of each template, and one for DOC."""
    rows = [(DOC, DOC, -1, 0, 0)]
    for number, t in enumerate(templates):
        raw = np.frombuffer(t.text.encode(), np.uint8)
        text, _, hashes = words_of(np.array([0, len(raw)]), raw)
        rows += [(int(h), int(c), number, t.k, i) for i, (h, c) in enumerate(zip(*grams_of(text, hashes, t.k)[1], strict=True))]
    return spark.createDataFrame(rows, "gram long, check long, template int, k int, place int")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each text: doc_id, n_words and spans, an array of (label, base, first_word, end_word, share).

    Grams never cross an exchange: only matches do, pre-aggregated by diagonal.
    """
    spark = docs.sparkSession
    if {t.k for t in templates} - set(SIZES):
        raise ValueError(f"templates' gram sizes are {SIZES}")
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = F.broadcast(template_grams(spark, templates))
    grams = rows.mapInArrow(_grams, GRAMS).select("row", "doc_id", "n_words", F.posexplode("grams").alias("at", "g"))
    short, first = SIZES[0], F.col("at") - 1
    word = F.when(F.col("k") == short, first).otherwise(first - F.greatest(F.col("n_words") - (short - 1), F.lit(0))).cast("int")
    verified = F.col("check").bitwiseXOR(F.col("said")) == 0  # no equality, so that the join's key stays a single long
    hits = grams.select("row", "doc_id", "n_words", "at", "g.gram", F.col("g.check").alias("said")).join(table, "gram").where(verified).withColumn("word", word)
    votes = hits.groupBy("row", "doc_id", "n_words", "template", (F.col("word") - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.count("*").alias("votes"), F.min("word").alias("first"), F.max(F.col("word") + F.col("k")).alias("end"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    about = spark.createDataFrame([(i, t.label, t.base, len(t.text.split()) - t.k + 1, float(t.least)) for i, t in enumerate(templates)], "template int, label string, base boolean, size int, least double")
    votes = votes.join(F.broadcast(about), "template", "left")
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = gap.isNull() | F.col("base") | (gap > NEAR) | (F.col("first") > reach + NEAR)
    spans = votes.withColumn("span", F.sum(new.cast("int")).over(by)).groupBy("row", "doc_id", "n_words", "template", "span")
    spans = spans.agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("end").alias("end"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.first("least").alias("least"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("size"))
    found = F.when((F.col("template") >= 0) & (share >= F.col("least")), F.struct("label", "base", F.col("first").cast("long").alias("first_word"), F.col("end").cast("long").alias("end_word"), share.alias("share")))
    return spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(found)).alias("spans")).drop("row")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda spans, f: F.transform(spans, lambda s: s[f])
    names: Column = F.array_join(F.array_sort(F.array_distinct(of(base, "label"))), ",")
    every: Column = F.array_join(F.array_sort(F.array_distinct(of(F.col("spans"), "label"))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(of(base, "first_word")).alias("first_word"),
        F.array_max(of(base, "first_word")).alias("last_word"),
        names.alias("base_labels"),
        every.alias("labels"),
        F.coalesce(F.array_max(of(F.col("spans"), "share")), F.lit(0.0)).alias("score"),
    )
