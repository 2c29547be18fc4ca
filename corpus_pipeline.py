"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the cluster's shared folder and hands the table to the next stage. All
stages but the last return the columns of ``documents``. A stage begins by removing the
tables that the stage before has stored for itself, as its result is written by then
(unless ``docs`` still reads them).

An empty table passes through as an empty table. Null texts are kept as they are by all
stages but the mix, which takes no document without words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common, mixing, near_dedup, packing, pii, toxicity
from tidelog.llm.queries import default_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application: the number of stored tables when its last stage began.
_begun: dict[str, int] = {}


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if f is not STAGES[0][1].__wrapped__ and app in _begun:  # a run's last result stays readable
            common.release(spark, _begun[app], docs)
        _begun[app] = common.mark(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier doesn't reject."""
    return toxicity.reject_toxic(docs, common.table(spark, sf_dir, "labels"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id; one row of
    those that share doc_id and text; rows without doc_id stay."""
    classes = near_dedup.near_duplicates(docs)
    kept = common.stored(classes.where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct(), "kept")
    known = common.keep_keys(docs.where("doc_id is not null"), kept, "doc_id")
    # only rows that share their doc_id move
    shared = common.stored(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared")
    n = shared.count()
    if n:
        alone = known.join(F.broadcast(shared) if n <= common.BROADCAST_KEYS else shared, "doc_id", "left_anti")
        several = common.keep_keys(known, shared, "doc_id", n).withColumn("__text", F.md5("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
        known = alone.unionByName(several)
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))


@stage
def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by their kind."""
    return pii.redact(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Several stages (trained scores, hashed signatures, tokens) can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, run_stage) in enumerate(STAGES):
        docs = run_stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
