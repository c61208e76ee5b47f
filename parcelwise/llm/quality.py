"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged alone: navigation (at least three `|`, or other menu
separators, between short entries), boilerplate (set phrases of site furniture: anywhere
in the line, as the SQL has it, or with `short_furniture` as most of a short line) and
punctuation (at least four of its non-space characters, and more than 30 of 100, are
ASCII punctuation). Failing lines are removed; a document that loses more than
half of its word characters is rejected, and so is one that fails the base rules.

A null or blank text has no words and fails the base rules (under 20 words). Everything
runs inside a row: no exchange, no Python. A text is held as arrays of its words' hashes,
so memory follows the longest text. Repeats of word windows are found by 64-bit hashes.
Repeated rows are judged alike; other columns are kept, those named as the operator's
own are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What parts words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
PHRASES = ("cookie policy", "privacy policy", "terms of service", "terms of use", "click here", "read more", "sign up", "log in", "enable javascript", "subscribe to our newsletter", "skip to content", "share this")
BOILERPLATE = "|".join(PHRASES)
WHOLE_PHRASE = rf"(?<![\p{{L}}\p{{N}}_])(?:{BOILERPLATE})(?![\p{{L}}\p{{N}}_])"
LONGEST_FURNITURE = 200
MENU = r"^[^|»›•]{0,24}([|»›•][^|»›•]{0,24}){3,}$"
#: The same lines for java.util.regex, which matches a repeated group by recursion unless it is possessive,
#: and so runs out of stack on long lines. An entry ends at the next separator, so nothing is to be taken back.
MENU_WALK = r"^[^|»›•]{0,24}+(?:[|»›•][^|»›•]{0,24}+){3,}+\z"
MOST_PUNCTUATION, FEW_MARKS, MOST_LOST = 30, 4, 50
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines")


def let(value: Column, f) -> Column:
    """f(value) with value worked out once; optimizer rules would else put its expression into f's lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def covered(hashes: Column) -> Column:
    """How many words stand in windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == b["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(j - 1, x) | same(j + 1, x), x["i"])), lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        reach = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, n: a + n)

    return let(let(ordered, starts), total)


def joined(hashes: Column, step: int) -> Column:
    """The hash of each value with the one `step` places on."""
    n = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def repeat_words(hashes: Column) -> Column:
    """Words inside word windows found twice or more, the first place included, from the words' hashes.

    A window's hash is made by doubling: of one word, of two, of four, of eight.
    """
    windows = let(let(joined(hashes, 1), lambda two: joined(two, 2)), lambda four: joined(four, WINDOW // 2))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(hashes) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def solid_part(text: Column) -> Column:
    """The text without white space; plain spaces, the many, go by a byte-wise replacement."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), SPACE, "")


def furniture(line: Column) -> Column:
    """Whether a line holds a set phrase anywhere, the rule of the SQL; plain searches of bytes, phrase by phrase."""
    return let(F.lower(line), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in PHRASES)))


def short_furniture(line: Column) -> Column:
    """Whether whole set phrases are more than half of the non-space characters of a short line."""

    def most(low: Column) -> Column:
        rest = F.length(solid_part(F.regexp_replace(low, WHOLE_PHRASE, "")))
        return let(F.length(solid_part(low)), lambda n: (n <= LONGEST_FURNITURE) & (2 * rest < n))

    return furniture(line) & let(F.lower(line), most)


def failed_line(line: Column, boilerplate=furniture) -> Column:
    dense = lambda solid: let(F.length(solid) - F.length(F.regexp_replace(solid, PUNCTUATION, "")), lambda marks: (marks >= FEW_MARKS) & (100 * marks > MOST_PUNCTUATION * F.length(solid)))
    parted = F.contains(line, F.lit("|")) | F.contains(line, F.lit("»")) | F.contains(line, F.lit("›")) | F.contains(line, F.lit("•"))
    return (parted & F.rlike(line, F.lit(MENU_WALK))) | boilerplate(line) | let(solid_part(line), dense)


def judge(docs: DataFrame, boilerplate=furniture) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines and clean_text.

    `boilerplate` tells the lines that fail as site furniture.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = lambda c: F.length(solid_part(c)).cast("long")
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.split(text, "\n")
    worded = F.filter(lines, lambda x: F.rlike(x, F.lit(WORD_CHAR)))
    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("n_repeat_words")))
    dups = let(F.transform(worded, lambda x: F.xxhash64(x)), lambda h: (F.size(h) - F.size(F.array_distinct(h))).cast("long"))
    good = F.filter(lines, lambda x: ~failed_line(x, boilerplate))
    found = F.struct(
        counted.alias("_words"),
        solid(text).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dups.alias("n_dup_lines"),
        let(good, lambda g: F.struct((F.size(lines) - F.size(g)).cast("long").alias("n"), F.array_join(g, "\n").alias("text"))).alias("_good"),
    )
    # A generator of one row: a filter on its columns is not pushed below it, which would work all of them out twice.
    out = docs.select(*(f"`{c}`" for c in docs.columns if c not in (*OWN, "clean_text")), F.inline(F.array(found)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.col("word_chars") - solid(F.col("_good.text"))
    out = out.withColumns({"n_words": F.col("_words.n_words"), "n_repeat_words": F.col("_words.n_repeat_words"), "n_bad_lines": F.col("_good.n"), "clean_text": F.col("_good.text")})
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * lost <= MOST_LOST * F.col("word_chars")))
    return out.drop("_words", "_good")


ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as ws, string_split(t, chr(10)) as ls from d),
g as (select r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as k from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW})),
twice as (select r, i from g qualify count(*) over (partition by r, k) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from twice) group by r),
l as (select r, x, regexp_replace(x, '{SPACE}', '', 'g') as s from (select r, unnest(ls) as x from w)),
m as (select r, x, s, regexp_matches(x, '{MENU}') or regexp_matches(lower(x), '{BOILERPLATE}')
  or length(s) - length(regexp_replace(s, '{PUNCTUATION}', '', 'g')) >= greatest({FEW_MARKS}, floor({MOST_PUNCTUATION} * length(s) / 100) + 1) as bad from l),
n as (select r, count(*) filter (s <> '') - count(distinct case when s <> '' then x end) as dups,
  sum(length(s)) as chars, coalesce(sum(length(s)) filter (bad), 0) as lost from m group by r),
j as (select doc_id, cast(len(ws) as bigint) as n_words, cast(chars as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) as bigint) as n_symbols, cast(dups as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, lost
  from d join w using (r) join n using (r) left join rep using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and 100 * lost <= {MOST_LOST} * word_chars as kept
from j
"""
