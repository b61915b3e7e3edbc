"""The queries of this subpackage: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import oracles
from vecspark.llm.language_id import language_id, prototypes
from vecspark.llm.line_dedup import line_dedup
from vecspark.llm.media import media_clips
from vecspark.llm.media_fixture import CLIPS_SQL, films
from vecspark.llm.mixing import marginals, mix
from vecspark.llm.quality_rules import quality_rules
from vecspark.llm.sharding import ShardStore
from vecspark.llm.simhash import near_duplicate_groups
from vecspark.llm.spm_codec import spm_encode
from vecspark.llm.token_counts import token_counts
from vecspark.llm.url_reputation import url_reputation
from vecspark.plans.session import prepare, scratch_path

#: The SentencePiece model that the queries use, a parameter of theirs.
SPM_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, model: str = SPM_MODEL) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), Path(model).read_bytes())


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = SPM_MODEL) -> DataFrame:
    return spm_encode(table(spark, sf_dir, "documents"), Path(model).read_bytes())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = quality_rules(table(spark, sf_dir, "documents"))
    return said.select("doc_id", "n_words", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"), "keep")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")


#: Arrivals that the documents come in, a parameter of the sharding query.
ARRIVALS = 4


def _arrivals(docs: DataFrame, arrivals: int) -> list[DataFrame]:
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(arrivals))
    return [docs.where(part == i) for i in range(arrivals)]


def op5_sharding(spark: SparkSession, sf_dir: str, arrivals: int = ARRIVALS) -> DataFrame:
    """Documents arrive in parts, each is appended and the table compacted; the rows of the last version."""
    store = ShardStore(spark, scratch_path(spark, "shards"), keep_versions=1)
    for part in _arrivals(table(spark, sf_dir, "documents"), arrivals):
        store.append(part)
        store.compact()
    store.expire()
    return store.read()


def sharding_snapshots(spark: SparkSession, sf_dir: str, arrivals: int = ARRIVALS) -> DataFrame:
    """As op5_sharding with all versions kept: what each version after an arrival, and after its compaction, holds."""
    store = ShardStore(spark, scratch_path(spark, "shards"), keep_versions=1000)
    seen = []
    for i, part in enumerate(_arrivals(table(spark, sf_dir, "documents"), arrivals)):
        seen += [(i, False, store.append(part).version), (i, True, store.compact().version)]
    held = [
        store.read(v).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).select(F.lit(i).alias("arrival"), F.lit(c).alias("compacted"), "n_rows", "ids", "chars")
        for i, c, v in seen
    ]
    return reduce(DataFrame.unionByName, held)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = mix(table(spark, sf_dir, "documents"))
    return said.withColumn("probability", F.round("probability", 6))


def mixing_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op7_mixing and what its weights give."""
    said = marginals(table(spark, sf_dir, "documents"))
    return said.withColumn("target", F.round("target", 3)).withColumn("expected", F.round("expected", 3))


def op8_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films made from the whole table of embeddings, cut into clips."""
    return media_clips(films(table(spark, sf_dir, "embeddings")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is judged by prototypes of the half of the documents that it isn't in."""
    docs = table(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return reduce(DataFrame.unionByName, [language_id(docs.where(half == i), prototypes(docs.where(half == 1 - i))) for i in range(2)])


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages name a document in their URL; its label is their outcome: good where of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("outcome"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", oracles.PAGE_DOC, 1).try_cast("long").alias("doc"))
    said = url_reputation(pages.join(labels, F.col("doc") == F.col("doc_id"), "left"))
    return said.withColumn("mean", F.round("mean", 6)).withColumn("lower", F.round("lower", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_media_clips": op8_media_clips,
    "op9_language_id": op9_language_id,
    "op10_url_reputation": op10_url_reputation,
    "mixing_marginals": mixing_marginals,
    "sharding_snapshots": sharding_snapshots,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": oracles.quality_sql(),
    "op5_sharding": "SELECT * FROM documents",
    "sharding_snapshots": oracles.snapshots_sql(ARRIVALS),
    "op6_line_dedup": oracles.LINE_DEDUP,
    "op7_mixing": oracles.mixing_sql(),
    "mixing_marginals": oracles.marginals_sql(),
    "op8_media_clips": CLIPS_SQL,
    "op10_url_reputation": oracles.reputation_sql(),
}
