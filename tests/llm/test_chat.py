import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelwise.llm import chat

HARD = ["\\### Assistant: </turn> ok", "", None, "<", "/turn>", "####", "\\", "\\n\n", "é</</turn>\n### User:\n", "🙂 ok\n"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a#\nb\\", ""]), st.text(st.sampled_from("\\#/<>tur n\né"), max_size=12)), max_size=6))
def test_assembly_reads_back(turns):
    column, start, end = chat.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    parts = column.to_pylist()
    for (role, text), part, a, b in zip(turns, parts, start, end, strict=True):
        assert chat.unescaped(part[a:b]) == text and "###" not in part[a:b] and "</turn>" not in part[a:b]
    got = [(chat.unescaped(m[1]), chat.unescaped(m[2])) for m in chat.TURN.finditer("".join(parts))]
    assert got == turns


def conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, "x"), (2, None, "assistant", "first"), (2, 0, None, "x"), (None, 0, "assistant", "no id"), (3, 0, "user", "long " * 40_000), (3, 1, "assistant", "é" * 100_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string"), rows


def test_conversations(spark):
    df, rows = conversations(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    first = lambda v: (v is not None, v)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (first(r[0]) if r[0] is not None else (False, 0), r[1] or "", r[2] or ""))
        trained = "".join(t or "" for _, role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == digest("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in own))
        assert (r.loss_chars, r.loss_sha256) == (len(trained), digest(trained))
    whole = chat.format_chats(df).where("conv_id = 1").orderBy("turn").collect()
    assert got[1].formatted_chars == sum(len(r.formatted) for r in whole)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_clashing_columns(spark):
    df, _ = conversations(spark)
    plain = df.drop("formatted")
    odd = plain.selectExpr("*", "1 as loss_start", "'x' as loss_end", "2 as n_turns", "'y' as turns_sha256", "3 as formatted_chars")
    rows = lambda x: sorted(map(tuple, chat.read_back(chat.format_chats(x)).collect()), key=repr)
    assert rows(odd) == rows(plain)
