"""The opN_ queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.llm.bpe import bpe_digests
from symlens.llm.brown import brown_scores
from symlens.llm.compression import fold_of, quality_scores, train
from symlens.llm.exact_dedup import exact_dedup
from symlens.llm.filter_audit import filter_audit
from symlens.llm.licenses import license_scan
from symlens.llm.line_dedup import line_dedup
from symlens.llm.mixing import mix_sources
from symlens.llm.packing import pack_documents
from symlens.llm.quality_rules import quality_rules
from symlens.llm.ranked_search import build_index, ranked_search
from symlens.llm.simhash import simhash_dedup
from symlens.llm.sql import ORACLES
from symlens.llm.substring_dedup import substring_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    """The rank file that the queries encode by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    """The pattern that cuts texts before the merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_documents(spark, sf_dir), vocabulary(), pattern=pattern())


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_documents(spark, sf_dir))


#: Target shares: the hot source is held to a tenth, the other nineteen share the rest alike.
WEIGHTS = {"src0": 0.1} | {f"src{i}": 0.9 / 19 for i in range(1, 20)}
SEED = 7


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_documents(spark, sf_dir), WEIGHTS, SEED)
    return mixed.select("doc_id", "source", "text", F.col("__copy").cast("long").alias("copy"), F.col("__order").alias("order_key"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir), runs=True)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_deleted").alias("n_deleted"), F.sha2("__kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), texts=False).drop("cleaned")


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold_of("doc_id") == 1, F.lit(False))
    scored = brown_scores(_documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ids=False).drop("ids")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(build_index(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
