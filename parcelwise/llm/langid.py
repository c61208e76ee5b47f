"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1 bits. One binary classifier for each bit
predicts it from hashed byte trigrams of the lower-cased text: a linear model whose
weights are the log ratio of the trigram's smoothed frequency among the languages with
that bit set and among the others. Decoding sums each bit's logistic loss against every
codeword, weighted by how well the bit's two sides can be told apart, takes the nearest
codeword and flags a text as ambiguous when the runner-up is close.

A null text or one without a letter gets `und`, score 0 and is not ambiguous; without
labelled rows every text does. Texts are scored whole, in blocks of bounded memory.
Ties go to the first language by name. Repeated rows are scored alike, other columns
are kept, and those named as the operator's own are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.common import by_blocks, renamed, small_batches, text_buffers

BUCKETS = 1 << 16
STEP = 1 << 20  # trigrams scored at once
ADDED = ("lang_pred", "score", "ambiguous")


def codewords(n: int, longest: int = 63) -> np.ndarray:
    """n rows of +1 / -1: all distinct splits of up to 7 languages, else a fixed pseudo-random dense code."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] << 1 >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    best = None
    for seed in range(20):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, longest))
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        both = (np.abs(code.sum(0)) < n).all()
        if both and (best is None or gap > best[0]):
            best = gap, code
    return best[1]


def trigrams(texts: pa.Array):
    """Yields (first row, row starts within the part, hashed trigrams) over the padded lower-case texts.

    Positions that would span two texts fall in bucket BUCKETS, which weighs nothing.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    offs, raw = text_buffers(pc.binary_join_element_wise(space, low, space, none))
    raw = np.append(raw, np.zeros(2, np.uint8))
    for lo in range(0, int(offs[-1]), STEP):
        hi = min(lo + STEP, int(offs[-1]))
        b = raw[lo : hi + 2].astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
        d0, d1 = int(np.searchsorted(offs, lo, "right")) - 1, int(np.searchsorted(offs, hi, "left"))
        ends = offs[d0 + 1 : d1 + 1]
        for back in (1, 2):
            at = ends - back - lo
            code[at[(at >= 0) & (at < hi - lo)]] = BUCKETS
        yield d0, np.maximum(offs[d0:d1] - lo, 0), code


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, bits)
    trust: np.ndarray  # by bit
    sharpness: float = 1.0
    ambiguous_below: float = 0.75

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray], smooth: float = 0.5) -> LanguageModel:
        langs = sorted(counts)
        code = codewords(len(langs))
        if not langs:
            return cls([], code, np.zeros((BUCKETS + 1, 1), np.float32), np.ones(1))
        share = np.stack([(counts[x] + smooth) / (counts[x].sum() + smooth * BUCKETS) for x in langs])
        weights, trust = np.zeros((BUCKETS + 1, code.shape[1]), np.float32), np.ones(code.shape[1])
        for b in range(code.shape[1]):
            on, off = code[:, b] > 0, code[:, b] < 0
            if on.any() and off.any():
                p, q = share[on].mean(0), share[off].mean(0)
                weights[:BUCKETS, b] = np.log(p / q)
                trust[b] = ((p - q) * np.log(p / q)).sum()
        trust = trust if trust.any() else np.ones(code.shape[1])  # languages that no bit tells apart
        return cls(langs, code, weights, trust / trust.sum())

    def margins(self, texts: pa.Array) -> np.ndarray:
        sums, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for d0, starts, code in trigrams(texts):
            starts = starts[starts < len(code)]
            sums[d0 : d0 + len(starts)] += np.add.reduceat(self.weights[code], starts, axis=0)
            n[d0 : d0 + len(starts)] += np.add.reduceat((code < BUCKETS).astype(np.int64), starts)
        return sums / np.sqrt(np.maximum(n, 1))[:, None]

    def predict(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.langs or not lettered.any():
            return pa.array(["und"] * len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        z = self.margins(texts)[:, None, :] * self.code[None] * self.sharpness
        loss = (np.logaddexp(0, -z) * self.trust).sum(2)
        near = np.exp(loss.min(1, keepdims=True) - loss)
        best = loss.argmin(1)
        score = np.where(lettered, 1 / near.sum(1), 0.0)
        names = np.where(lettered, np.array(self.langs, object)[best], "und")
        return pa.array(names.tolist(), pa.string()), score, lettered & (score < self.ambiguous_below)


def _counted(batches):
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in pc.unique(batch.column(1)).to_pylist():
            own = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in by_blocks([batch.filter(pc.equal(batch.column(1), lang))], "text", lambda b: b.column(0)):
                for _, _, code in trigrams(part):
                    own += np.bincount(code, minlength=BUCKETS + 1)[:BUCKETS]
    for lang, own in found.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, rows_per_lang: int = 1000) -> LanguageModel:
    """Learns from `text` and `lang` of a bounded sample of the labelled rows.

    `rows_per_lang` bounds the sample: rows whose hash falls below the share that makes
    about that many of each language, at most twice that many for all together. The
    driver gets their summed trigram counts, BUCKETS rows a language at most. A row is
    drawn by the hash of its id and text, so rows without an id are drawn one by one.
    """
    known = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel.from_counts({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(min(1.0, rows_per_lang / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    some = known.where(draw < share[F.col("lang")]).select("text", "lang", "doc_id").limit(2 * rows_per_lang * len(sizes))
    made = small_batches(some).select("text", "lang").mapInArrow(_counted, "lang string, bucket long, n long")
    summed = made.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, np.ndarray] = {}
    for lang, own in summed.groupby("lang"):
        counts[lang] = np.zeros(BUCKETS, np.int64)
        counts[lang][own["bucket"]] = own["n"]
    return LanguageModel.from_counts(counts)


def _predicted(batches, model: LanguageModel):
    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        names, score, ambiguous = model.predict(block.column(block.schema.get_field_index("text")))
        return renamed(block, lang_pred=names, score=pa.array(score), ambiguous=pa.array(ambiguous))

    yield from by_blocks(batches, "text", one)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; only `text` is looked at.

    The model (64k weights a bit) is broadcast; its size does not depend on the corpus.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in ADDED]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))])
    return small_batches(docs).select(*(f"`{f.name}`" for f in fields)).mapInArrow(lambda it: _predicted(it, held.value), schema)
