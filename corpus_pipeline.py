"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.line_dedup import line_dedup
from vecspark.llm.mixing import mix
from vecspark.llm.quality_rules import quality_rules
from vecspark.llm.queries import SPM_MODEL, table
from vecspark.llm.simhash import drop_near_duplicates
from vecspark.llm.spm_codec import spm_encode
from vecspark.plans.session import cut, position, positional, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject."""
    return quality_rules(docs, carry=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; ``n_chars`` follows the text.

    A document whose every line was removed is gone: its text stands in earlier documents. Texts that
    were empty before stay.
    """
    rows, text, size = positional(docs), position(docs, "text"), position(docs, "n_chars")
    out = line_dedup(rows, position(docs, "doc_id"), text, "removed").where((F.col("removed") == 0) | (F.trim(F.regexp_replace(text, "\n", " ")) != ""))
    chars = F.when(F.col("removed") > 0, F.length(text)).otherwise(F.col(size)).cast(rows.schema[size].dataType)
    return out.withColumn(size, chars).select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return mix(docs, carry=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, checked against the SentencePiece library and decoded again."""
    return spm_encode(docs, Path(SPM_MODEL).read_bytes())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", encoding),
]

#: Fingerprint search and tokenisation can't be expressed in SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written; the last one's input stays for it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
            release(given)
    return docs
