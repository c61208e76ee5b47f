"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import chat, langid, licenses, packing, pqdedup, quality, secretscan, simhash, tokenfile, wordbpe
from parcelwise.llm.common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokenfile.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(spark, made).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(documents(spark, sf_dir).select("doc_id", "text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(rows))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    done = wordbpe.decode(wordbpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict:
    found = (op1_language_id, op2_token_file, op3_secret_scan, op4_quality_rules, op5_chat_format, op6_license_scan, op7_word_bpe, op8_simhash, op9_embedding_dedup, op10_packing)
    return {f.__name__: f for f in found}


CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n as (select *, 4 + 2 + 8 + length(role) + length(text)
    + 2 * length(role || text) - length(replace(role || text, '\', '')) - length(replace(role || text, '#', ''))
    + (length(role) - length(replace(role, '</', ''))) / 2 + (length(text) - length(replace(text, '</', ''))) / 2
    + length(role) - length(replace(role, chr(10), '')) as size from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from n group by conv_id
"""

EMBEDDINGS_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
s as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select a.vec_id as x, b.vec_id as y from s a join s b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x),
least as (select x, min(y) as m from reach group by x),
n as (select x, count(*) as n from link group by x)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id <= coalesce(m, vec_id) as kept
from v left join n on n.x = vec_id left join least on least.x = vec_id
"""


def either_case(letters: str) -> str:
    """A pattern of the ASCII letters in either case and of nothing else, in an engine that folds Unicode."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in letters)


def secrets_sql() -> str:
    """Matches are found by the rules' patterns; each one's place is its first occurrence behind the match before it."""
    words = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
    folded = "(?ai:password|passwd|secret|token|api_?key)"
    rules = [(k, r.kind, r.pattern.replace(folded, words).replace("'", "''"), r.group, r.least) for k, r in enumerate(secretscan.RULES)]
    table = ", ".join(f"({k}, '{kind}', '{pattern}', {group}, {least})" for k, kind, pattern, group, least in rules)
    found = " union all ".join(f"select r, {k} as k, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as gs from d" for k, _, pattern, group, _ in rules)
    base = f"k < {len(secretscan.BASE)}"
    listed = "kind || ':' || a || ':' || z"
    return f"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
rule(k, kind, pattern, grp, least) as (values {table}),
m as (select * from ({found}) where len(ms) > 0),
place(r, k, i, a, z) as (select r, k, 0, 0, 0 from m
  union all select r, k, i + 1, z + instr(substr(t, z + 1), ms[i + 1]) - 1, z + instr(substr(t, z + 1), ms[i + 1]) - 1 + length(ms[i + 1])
  from place join m using (r, k) join d using (r) where i < len(ms)),
span as (select r, k, kind, cast(a as bigint) as a, cast(z as bigint) as z from place join m using (r, k) join rule using (k) where i > 0 and length(gs[i]) >= least)
select doc_id, {", ".join(f"count(*) filter (kind = '{x.kind}') as n_{x.kind}" for x in secretscan.BASE)},
  sha256(coalesce(string_agg({listed}, ',' order by a, k) filter ({base}), '')) as base_sha256, coalesce(string_agg({listed}, ',' order by a, k), '') as spans
from d left join span using (r) group by r, doc_id
"""


def licenses_sql() -> str:
    rows, about = [], []
    for number, t in enumerate(licenses.TEMPLATES):
        words = t.text.split()
        about.append(f"({number}, '{t.label}', {str(t.base).lower()}, {len(words) - t.k + 1}, {t.least!r}e0)")
        rows += [f"({number}, {t.k}, {i}, '{' '.join(words[i : i + t.k])}')" for i in range(len(words) - t.k + 1)]
    grams = " union all ".join(f"select r, {k} as k, i, array_to_string(ws[i + 1:i + {k}], ' ') as gram from (select r, ws, unnest(range(0, len(ws) - {k - 1})) as i from w where len(ws) >= {k})" for k in licenses.SIZES)
    near = licenses.NEAR
    return rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
template(template, k, place, gram) as (values {", ".join(rows)}),
about(template, label, base, size, least) as (values {", ".join(about)}),
vote as (select r, template, i - place as diagonal, count(*) as votes, min(i) as a, max(i + k) as z from ({grams}) join template using (k, gram) group by all),
parted as (select *, diagonal - lag(diagonal) over o as gap, max(z) over (partition by r, template order by diagonal rows between unbounded preceding and 1 preceding) as reach
  from vote join about using (template) window o as (partition by r, template order by diagonal)),
numbered as (select *, sum(case when gap is null or base or gap > {near} or a > reach + {near} then 1 else 0 end) over (partition by r, template order by diagonal) as span from parted),
span as (select r, label, base, min(a) as a, least(1e0, sum(votes) / any_value(size)) as share from numbered group by r, template, span, label, base having least(1e0, sum(votes) / any_value(size)) >= any_value(least))
select doc_id, cast(any_value(len(ws)) as bigint) as n_words, count(*) filter (base) as n_base, cast(min(a) filter (base) as bigint) as first_word, cast(max(a) filter (base) as bigint) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(share), 0e0) as score
from w left join span using (r) group by r, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secrets_sql(), "op4_quality_rules": quality.ORACLE_SQL, "op5_chat_format": CHAT_SQL, "op6_license_scan": licenses_sql(), "op9_embedding_dedup": EMBEDDINGS_SQL}
