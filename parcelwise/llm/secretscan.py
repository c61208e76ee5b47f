"""Secret scanning through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: literal
runs must occur, so their trigrams must; alternatives are or-ed; whatever has no fixed
text adds nothing. Each block of texts gets an inverted index of the trigrams that any
rule asks for (over bytes with A-Z in lower case). A rule's postings are intersected and
united as its query says, and only the candidates are verified with the expression
itself. A rule whose query is empty, such as a run of hex digits, scans every text.

Null texts count as empty and have no spans; overlapping spans of different kinds all
stay; repeated rows are scanned alike; an empty table gives none; other columns are kept,
but one named `spans` is replaced. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.common import by_blocks, renamed, small_batches, text_buffers

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in the order in which spans of one start are listed.
# A run of hex digits is maximal wherever it matches, so its least length stands in the pattern.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Further public token formats.
FURTHER = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + FURTHER

ANY = ("any",)
MOST_STRINGS = 64
#: ASCII letters that ignoring case in Unicode also finds in letters beyond ASCII (dotted and dotless i, long s, Kelvin sign).
FOLDED = "iIkKsS"


def both(a: tuple, b: tuple) -> tuple:
    return b if a == ANY else a if b == ANY else ("and", a, b)


def either(parts: list[tuple]) -> tuple:
    return ANY if ANY in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_strings(strings: set[str]) -> tuple:
    """What texts hold if they hold one of the strings."""
    found = []
    for s in sorted(strings):
        raw = s.encode()
        if len(raw) < 3:
            return ANY
        found.append(("and", *(("has", raw[i : i + 3]) for i in range(len(raw) - 2))))
    return either(found)


def _letter(code: int, flags: int) -> set[str] | None:
    """What a literal stands for, A-Z in lower case; None if it also matches characters that case folding adds to it."""
    if flags & re.IGNORECASE and not flags & re.ASCII and (code >= 128 or chr(code) in FOLDED):
        return None
    return {chr(code).lower() if code < 128 else chr(code)}


def _node(op, arg, flags: int) -> tuple[set[str] | None, tuple]:
    """(all strings that the node matches, if they are few; the query that its matches fulfil)."""
    if op is sre.LITERAL:
        return _letter(arg, flags), ANY
    if op is sre.IN and all(x is sre.LITERAL for x, _ in arg) and len(arg) <= 8:
        letters = [_letter(c, flags) for _, c in arg]
        return None if None in letters else set().union(*letters), ANY
    if op is sre.SUBPATTERN:
        _, add, remove, inner = arg
        return _sequence(inner, (flags | add) & ~remove & ~(re.UNICODE if add & re.ASCII else re.ASCII if add & re.UNICODE else 0))
    if op is sre.BRANCH:
        parts = [_sequence(x, flags) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANY
        return None, either([q if s is None else of_strings(s) for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner, flags)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if least and strings is not None:
            if (least, most) == (1, 1):
                return strings, ANY
            return None, of_strings(strings)
        return None, query if least else ANY
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes, flags: int) -> tuple[set[str] | None, tuple]:
    held, query, whole = {""}, ANY, True
    for op, arg in nodes:
        strings, need = _node(op, arg, flags)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        whole = False
        query = both(query, of_strings(held))
        held = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
        query = both(query, need)
    return (held, ANY) if whole else (None, both(query, of_strings(held)))


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of an expression, ANY if it has no mandatory trigram."""
    parsed = _parser.parse(pattern)
    strings, query = _sequence(parsed, parsed.state.flags)
    return of_strings(strings) if strings is not None else query


def trigrams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*(trigrams_of(q) for q in query[1:])) if query != ANY else set()


class Scanner:
    """Rules with their queries and the lookup table of the trigrams asked for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.asked = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.number = {t: i for i, t in enumerate(self.asked)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            self.table[int.from_bytes(t, "big")] = i
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32

    def postings(self, texts: pa.Array) -> list[np.ndarray]:
        """By trigram asked for, the ascending rows that hold it."""
        offs, raw = text_buffers(texts)
        b = self.low[raw].astype(np.uint32)
        found = self.table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] if len(b) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(found >= 0)
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + 2 < offs[row + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(texts) + row[inside])
        which, rows = np.divmod(pairs, max(len(texts), 1))
        return np.split(rows, np.searchsorted(which, np.arange(1, len(self.asked))))

    def candidates(self, query: tuple, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query == ANY:
            return np.arange(n)
        if query[0] == "has":
            return postings[self.number[query[1]]]
        join = np.intersect1d if query[0] == "and" else np.union1d
        out = self.candidates(query[1], postings, n)
        for q in query[2:]:
            if query[0] == "and" and not len(out):
                break
            out = join(out, self.candidates(q, postings, n))
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
        postings, n = self.postings(texts), len(texts)
        found: list[list] = [[] for _ in range(n)]
        held: dict[int, str] = {}
        for order, (rule, regex, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, n).tolist():
                if (text := held.get(i)) is None:
                    text = held[i] = texts[i].as_py() or ""
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), order, m.end()))
        return [[(self.rules[k][0].kind, a, b) for a, k, b in sorted(x)] for x in found]


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _scanned(batches, rules):
    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        found = scanner(rules).scan(block.column(block.schema.get_field_index("text")))
        spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], ARROW_SPANS)
        return renamed(block, spans=spans)

    yield from by_blocks(batches, "text", one)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `spans`: array of (kind, start, end) by start, then by the order of the rules. No exchange."""
    fields = [f for f in docs.schema.fields if f.name != "spans"]
    schema = T.StructType([*fields, T.StructField("spans", SPANS)])
    return small_batches(docs).select(*(f"`{f.name}`" for f in fields)).mapInArrow(lambda it: _scanned(it, rules), schema)


def listed(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts and the digest of the base spans, and all spans as text."""
    kinds = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scanned.select("doc_id", *(count(k).alias(f"n_{k}") for k in kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with each stretch that the spans (by start) cover replaced by mark."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def marked(texts: pa.Array, spans: list[list[tuple[int, int]]], mark: str) -> pa.Array:
    """The texts, those with spans redacted."""
    if not any(spans):
        return texts
    done = texts.to_pylist()
    for i, own in enumerate(spans):
        if own:
            done[i] = without(done[i], own, mark)
    return pa.array(done, texts.type)


def _with_text(block: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
    at = block.schema.get_field_index("text")
    return block.set_column(at, block.schema.field(at), texts)


def _redacted(batches, mark: str):
    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = (block.column(block.schema.get_field_index(c)) for c in ("text", "spans"))
        own = [[(s["start"], s["end"]) for s in x or ()] for x in spans.to_pylist()]
        return _with_text(block.drop_columns(["spans"]), marked(texts, own, mark))

    yield from by_blocks(batches, "text", one)


def _scrubbed(batches, rules, mark: str):
    def one(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column(block.schema.get_field_index("text"))
        return _with_text(block, marked(texts, [[(a, b) for _, a, b in x] for x in scanner(rules).scan(texts)], mark))

    yield from by_blocks(batches, "text", one)


def _counted(out: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def redacted(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """scanned without `spans`, each stretch that spans cover in `text` replaced by `mark`; n_chars follows, if there.

    Texts without spans stay as they are, null included. Time is linear in a text and its spans.
    """
    schema = T.StructType([f for f in scanned.schema.fields if f.name != "spans"])
    return _counted(small_batches(scanned).mapInArrow(lambda it: _redacted(it, mark), schema))


def scrubbed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with the texts of redacted(scan(docs)), all columns kept: found and replaced in one pass, by one worker a task."""
    return _counted(small_batches(docs).mapInArrow(lambda it: _scrubbed(it, rules, mark), docs.schema))
