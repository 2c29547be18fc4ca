"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import html_text, impact_topk, mixing, near_dedup, pii, prefix_forest, sharding, substring_dedup, toxicity
from .near_dedup import near_duplicates
from .packing import pack
from .sharding import shard
from .substring_dedup import dedup_substrings


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of the first training position; documents that are not taken come last."""
    mixed = mixing.curriculum(table(spark, sf_dir, "documents")).withColumn("first_position", F.get("positions", F.lit(0)))
    return mixed.orderBy(F.col("first_position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the document's near-duplicate class."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version's rows (the text as its hash), and whether each one's shard is about the
    target's size at most; shard_id, shard_bytes and shard_file are columns of ``store.read``."""
    store, version = shard(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2(text, 256).alias("text_sha256"), F.col("text").isNull().alias("no_text"), (F.col("shard_bytes") <= 2 * store.target).alias("within_target"))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the base spans; spans also holds what the bootstrapping adds."""
    return pii.spans_text(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_prefix_forest_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"))


def op9_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


QUERIES = (
    op1_substring_dedup, op2_curriculum_mixing, op3_weak_toxicity, op4_best_fit_packing, op5_minhash_near_dedup,
    op6_tiered_sharding, op7_bootstrapped_pii, op8_prefix_forest_ann, op9_impact_topk, op10_text_density,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op2_curriculum_mixing": mixing.ORACLE, "op5_minhash_near_dedup": near_dedup.ORACLE, "op6_tiered_sharding": sharding.ORACLE, "op9_impact_topk": impact_topk.ORACLE}
