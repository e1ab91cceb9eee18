"""From raw documents to token ids: five stages, each a Parquet table for the next.

Quality rules drop documents and failing lines, line dedup deletes blocks that
an earlier document has, SimHash keeps one document of each group of near
duplicates, mixing repeats documents towards target weights of their sources and
deals them to files at random, in random order within each, and the last stage
gives the token ids of every row of these files, in their order, with digests of
the ids and of the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.llm import bpe, line_dedup, mixing, quality_rules, simhash
from symlens.llm.queries import SEED, WEIGHTS, pattern, vocabulary
from symlens.llm.work import materialize


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(quality_rules.clean_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.deduplicated(docs, runs=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles; texts within four of 64 bits, or of a Jaccard similarity of 0.8, are near copies."""
    return simhash.near_duplicates_removed(docs, similarity=0.8, shingle_words=5, radius=4, n_blocks=7)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, WEIGHTS, SEED).drop("__copy", "__rate", "__order")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs, vocabulary(), pattern=pattern(), ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mixing sources", mixture), ("byte-level bpe", tokens)]

#: SQL can express neither the fingerprints nor the merges of BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
