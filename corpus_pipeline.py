"""The corpus pipeline: five stages over `documents`, each stored as Parquet and read again by the next.

Language ID drops texts without a language, quality rules drop rejected documents and
failing lines, SimHash keeps one document of each group of near copies, secret scans
redact, packing cuts what is left into sequences. All stages but the last return the
columns of documents. An empty table gives an empty table in every stage; `lang`, `source`
and further columns may be null and stay as they are. The stored tables of the stages stay in
shared storage until `parcelwise.session.released` or somebody removes them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import langid, packing, quality, queries, secretscan, simhash
from parcelwise.llm.common import spread
from parcelwise.session import stored

#: A text whose best language is less likely than this is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found with a score of LEAST_SCORE or more.

    Null, blank and letterless texts go; ties between languages go to the first by name;
    repeated rows and rows without a doc_id are judged by their text, as any other.
    """
    model = langid.fit(docs.where(~queries.held_out()))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, `text` without its failing lines and `n_chars` its length.

    Null and blank texts fail (under 20 words); each row is judged on its own, so repeated
    rows and rows without a doc_id all stay or all go.
    """
    judged = quality.judge(docs, quality.short_furniture).where("kept")
    clean = judged.withColumn("text", F.col("clean_text"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by doc_id, null ids last, then by text.

    Rows equal in doc_id and text count as one. Texts without words, null included, are
    near copies of each other. Where a doc_id repeats with different texts, each belongs to
    its own group, and a group without any id keeps a row as well.
    """
    return simhash.firsts(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each stretch of `text` that spans of secrets cover replaced by a mark, `n_chars` its length.

    Null texts stay null, texts without secrets as they are; repeated rows and rows
    without a doc_id are scanned each.
    """
    return secretscan.scrubbed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row in sequences of at most 2,048 ids.

    A null or empty text gives its end id alone; repeated rows and rows without a doc_id
    are packed each.
    """
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole of documents; the last one's rows."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
