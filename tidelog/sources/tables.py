"""Sources that need no network: tables, timers and load generators, for batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.fields import clock, format_time

#: Words of the timer's sentences.
SENTENCE = (("a grey", "a young", "an old", "the quiet"), ("heron", "otter", "badger", "lynx"), ("crosses", "watches", "finds", "leaves"), ("the river", "a field", "the road", "an island"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as messages: each column of a simple type is a field."""
    return model.messages(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _stamped(df: DataFrame, source: str, zone: str, at: Column | None = None) -> DataFrame:
    local, offset = clock(at, zone)
    return df.withColumn("date", format_time("datetime", local, offset)).withColumn("from", F.lit(source))


def _sentence(seed: Column) -> Column:
    words = [F.element_at(F.array(*map(F.lit, part)), F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(len(part))).cast("int") + 1) for i, part in enumerate(SENTENCE)]
    return F.concat_ws(" ", *words)


def timer(spark: SparkSession, ticks: int | None = None, seconds: int = 1, zone: str = "UTC") -> DataFrame:
    """A message every ``seconds``: a stream, or for tests and replays a batch of ``ticks``."""
    if ticks is None:
        rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % seconds == 0)
        df = rate.select(F.col("value").alias(model.SEQ), F.col("timestamp").alias("_at"))
    else:
        df = spark.range(ticks).select(F.col("id").alias(model.SEQ), (F.current_timestamp() + F.make_interval(secs=F.col("id") * seconds)).alias("_at"))
    df = _stamped(df, "tidelog://timer", zone, F.col("_at")).drop("_at")
    return df.withColumn("program", F.lit("tidelog")).withColumn("payload", _sentence(F.col(model.SEQ)))


def infinity(spark: SparkSession, rows: int | None = None, length: int = 100, zone: str = "UTC") -> DataFrame:
    """The load generator: messages of ``length`` letters, as many as the engine takes."""
    if rows is None:
        df = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 100_000).load().select(F.col("value").alias(model.SEQ))
    else:
        df = spark.range(rows).select(F.col("id").alias(model.SEQ))
    return _stamped(df, "tidelog://infinity", zone).withColumn("payload", F.repeat(F.lit("a"), F.lit(length)))
