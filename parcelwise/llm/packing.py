"""Packing documents into sequences by non-negative least squares over length patterns.

A document is encoded, closed by `end_id` and cut into full windows and one rest. The
rests' length histogram (at most `window` - 1 counts, whatever the corpus) is the only
thing the driver sees. Shallow patterns (one, two or three lengths that fill a window)
are enumerated, their repeat counts solved by non-negative least squares against the
histogram, rounded down, and what remains of the histogram is packed greedily, again
by pattern and count, so the plan has a bounded size and no document is ever listed.
Documents find their slots by rank within their length.

Null texts count as empty and give the end id alone; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.bytebpe import encode
from parcelwise.llm.common import row_blocks, small_batches
from parcelwise.session import stored

PIECES = "part long, doc_id long, start long, length long, doc_tokens long, rank long, ids binary"


def nnls(columns: np.ndarray, uses: np.ndarray, target: np.ndarray, rounds: int = 60, settled: float = 0.25) -> np.ndarray:
    """x >= 0 that brings A x near `target`; A's column j has uses[j, i] at row columns[j, i], or 0 at row 0.

    Cyclic coordinate descent: each step is the exact minimum along one pattern, until no count moves by `settled`.
    """
    x, rest = np.zeros(len(columns)), target.astype(float)
    norm = (uses.astype(float) ** 2).sum(1)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(columns)):
            at, use = columns[j], uses[j]
            step = max(-x[j], float(rest[at] @ use) / norm[j])
            if step:
                x[j] += step
                rest[at] -= step * use
                moved = max(moved, abs(step))
        if moved < settled:
            break
    return x


def shallow_patterns(counts: np.ndarray, window: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Combinations of one to three present lengths that fill a window, fullest and most frequent first."""
    present = np.flatnonzero(counts)
    found = {(n,) for n in present if n == window}
    found |= {(int(a), int(window - a)) for a in present if a <= window - a < len(counts) and counts[window - a]}
    common = present[np.argsort(-counts[present], kind="stable")][:256]
    triples = []
    for a in common:
        rest = window - a - common
        ok = (rest > 0) & (rest < len(counts))
        ok[ok] &= counts[rest[ok]] > 0
        triples += [tuple(sorted((int(a), int(b), int(window - a - b)))) for b in common[ok]]
    ranked = sorted(set(triples), key=lambda t: (-min(counts[i] for i in t), t))
    return sorted(found) + ranked[: max(0, most - len(found))]


def pack_plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that uses each length exactly counts[length] times."""
    left, plan = counts.astype(np.int64).copy(), []
    patterns = [tuple(sorted(p, reverse=True)) for p in shallow_patterns(left, window)]
    if patterns:
        width = max(map(len, patterns))
        columns, uses = np.zeros((len(patterns), width), np.int64), np.zeros((len(patterns), width))
        for j, p in enumerate(patterns):
            for i, (n, k) in enumerate(Counter(p).items()):
                columns[j, i], uses[j, i] = n, k
        solved = np.floor(nnls(columns, uses, left) + 1e-6).astype(np.int64)
        for j in np.argsort(-solved, kind="stable"):
            use = Counter(patterns[j])
            if n := min(int(solved[j]), *(int(left[i]) // k for i, k in use.items())):
                plan.append((patterns[j], n))
                for i, k in use.items():
                    left[i] -= n * k
    while (present := np.flatnonzero(left)).size:  # best fit by falling length, many sequences at once
        room, taken, held = window, Counter(), present
        while (i := int(np.searchsorted(held, room, "right")) - 1) >= 0:
            n = int(held[i])
            if taken[n] < left[n]:
                taken[n] += 1
                room -= n
            else:
                held = np.delete(held, i)
        n = min(int(left[i]) // k for i, k in taken.items())
        plan.append((tuple(sorted(taken.elements(), reverse=True)), n))
        for i, k in taken.items():
            left[i] -= n * k
    return plan


class Slots:
    """Where the r-th rest of each length goes: ranges of ranks by length."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], window: int):
        by: dict[int, list[tuple[int, int, int]]] = {}
        used: Counter = Counter()
        first = 0
        for lengths, n in plan:
            offset = 0
            for length in lengths:
                by.setdefault(length, []).append((used[length], first, offset))
                used[length] += n
                offset += length
            first += n
        self.n_sequences = first
        self.by = {k: np.array(v, np.int64) for k, v in by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            table = self.by[int(length[own[0]])]
            row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
            sequence[own], offset[own] = row[:, 1] + rank[own] - row[:, 0], row[:, 2]
        return sequence, offset


def _pieces(batches, tokenizer: str, end_id: int, window: int):
    part = TaskContext.get().partitionId()
    ranks: Counter = Counter()
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in row_blocks(texts):
            rows: list[tuple] = []
            for doc, text in zip(docs[lo:hi], texts.slice(lo, hi - lo), strict=True):
                ids = np.append(encode(tokenizer, text.as_py()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    rows.append((part, doc, start, n, len(ids), ranks[n], piece.tobytes()))
                    ranks[n] += 1
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _placed(batches, slots: Slots):
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n))
        rank = get("rank").to_numpy() + get("before").to_numpy()
        sequence, offset = slots.find(get("length").to_numpy(), rank)
        keep = [n for n in batch.schema.names if n not in ("rank", "before", "part")]
        yield pa.RecordBatch.from_arrays([*map(get, keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids_crc32, ids (32-bit), sequence_id, offset.

    Texts are read and encoded once, without an exchange; pieces are stored with their
    rank among the pieces of their length in their partition. Counts of (partition,
    length) give each partition's first rank; only those counts and the pieces' short
    columns cross an exchange, with ids=True the pieces themselves too.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = rows.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, window), PIECES)
    if not ids:
        made = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    pieces = stored(made, "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(window + 1, np.int64)
    for r in by_length:
        counts[r["length"]] = r["n"]
    slots = Slots(pack_plan(counts, window), window)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counted.select("part", "length", before.alias("before"))
    ranked = pieces.join(first, ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", *([F.crc32("ids").alias("ids_crc32"), "ids"] if ids else ["ids_crc32"]), "rank", "before", "part")
    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, " + "ids binary, " * ids + "sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _placed(it, slots), schema)
