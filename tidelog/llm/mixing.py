"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule, piecewise linear over training time 0..1. Its
integral is the source's weight; the targets share all words by weight, stop at
``max_repeats`` times the source's own words, and share the excess by weight among the
others (closed form: sources by ascending cap/weight, the first level of the water that
no later source exceeds). A source's documents, in the order of a hash of their ids and
texts, form its word stream, repeated as often as the target needs. The cumulative demand
target * integral(0..t) / integral(0..1) is inverted at the middle of each document's
words, which gives the document's training position; documents are range-sorted by it.

A source's running word count is made of cells of the hash (their sums are few rows)
and a window within a cell, so that a source with a third of all rows is many tasks.
``mix`` moves the texts twice: once to their cell, where they get their positions, and
each copy once to its range of training time. Ranges hold about equal words: the demand
of all cells is summed over a grid of times, which is cut into equal parts.

Defined results: null text has size 0; documents of size 0 are never taken; a null
source is a source of its own, the last one; a source without words has target 0; an
empty table gives an empty result; rows that share a doc_id are documents each (rows
that share the text, too, are one cell's); other columns are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_REPEATS = 3
#: Schedules of the sources in turn, from the weight at time 0 to that at time 1: they integrate to 1, 2 and 3.
RAMPS = ((1.5, 0.5), (2.0, 2.0), (2.0, 4.0))
WORD = r"[^\x20\x09-\x0D]+"
#: Documents and words of a cell, about: what a window sorts at once.
CELL_ROWS, CELL_WORDS = 4_000, 2_000_000
#: Bytes of text of a task that moves texts; grid steps of training time, and points of words, for each of these tasks.
TASK_BYTES, STEPS, POINTS = 64 << 20, 16, 32
#: Up to so many sources (and bytes of their names) and cells are broadcast, as counted.
BROADCAST_SOURCES, BROADCAST_NAMES, BROADCAST_CELLS = 20_000, 4 << 20, 100_000
KNOTS = "array<struct<t:double,w:double>>"


def ramp(start: Column, end: Column) -> Column:
    """A schedule that goes straight from one weight to another."""
    return F.array(F.struct(F.lit(0.0).alias("t"), start.cast("double").alias("w")), F.struct(F.lit(1.0).alias("t"), end.cast("double").alias("w")))


def segments(knots: Column) -> Column:
    """Of (t, w) knots by ascending t, from 0 to 1: segments (t0, h, w0, w1, area)."""
    pairs = F.zip_with(F.slice(knots, 1, F.size(knots) - 1), F.slice(knots, 2, F.size(knots) - 1), lambda a, b: F.struct(a.t.alias("t0"), (b.t - a.t).alias("h"), a.w.alias("w0"), b.w.alias("w1"), ((a.w + b.w) / 2 * (b.t - a.t)).alias("area")))
    return pairs


def integral(segs: Column) -> Column:
    return F.aggregate(segs, F.lit(0.0), lambda s, x: s + x.area)


def invert(segs: Column, total: Column, share: Column) -> Column:
    """The time by which ``share`` of the schedule's integral ``total`` has passed."""
    start = F.struct((share * total).alias("left"), F.lit(None).cast("double").alias("t"))

    def step(s: Column, x: Column) -> Column:
        here = s.t.isNull() & (s.left <= x.area) & (x.area > 0)
        root = x.w0 + F.sqrt(F.greatest(F.lit(0.0), x.w0 * x.w0 + 2 * (x.w1 - x.w0) / x.h * s.left))
        at = x.t0 + F.when(s.left <= 0, F.lit(0.0)).otherwise(2 * s.left / root)
        return F.struct(F.when(s.t.isNull(), s.left - x.area).otherwise(s.left).alias("left"), F.when(here, at).otherwise(s.t).alias("t"))

    return F.least(F.lit(1.0), F.coalesce(F.aggregate(segs, start, step, lambda s: s.t), F.lit(1.0)))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight), one for each source."""
    everything = Window.partitionBy()
    # one row a source: the window is over sources, not over documents
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (sources.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", F.row_number().over(order))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open")))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = level.withColumn("first", F.min(F.when(fits, F.struct("at", "level"))).over(everything))
    target = F.when(F.col("at") >= F.col("first.at"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap"))
    return level.withColumn("target", target).drop("cap", "total", "capped", "open", "at", "level", "first")


def _streamed(docs: DataFrame, row: Column) -> DataFrame:
    """(row, source, size, order): a row for each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    return docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("order"))


class Plan:
    """What the sources' sums decide, as small tables: ``sources`` (of, sid, buckets, source_size,
    target, segs, weight) and ``cells`` (sid, bucket, before, words)."""

    def __init__(self, streamed: DataFrame, schedules: DataFrame | None, ramps: Sequence[tuple[float, float]], max_repeats: int):
        slim = streamed.select("source", "order", "size")
        sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        sources = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        if schedules is None:
            each = F.element_at(F.array(*[ramp(F.lit(a), F.lit(b)) for a, b in ramps]), (F.col("sid") - 1) % len(ramps) + 1)
            sources = sources.withColumn("knots", each)
        else:
            given = schedules.select(F.col("source").alias("of"), "knots")
            sources = sources.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
            sources = sources.withColumn("knots", F.coalesce("knots", ramp(F.lit(0.0), F.lit(0.0))))
        sources = sources.withColumn("segs", segments(F.col("knots"))).withColumn("weight", integral(F.col("segs")))
        buckets = F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.ceil(F.col("source_size") / CELL_WORDS))
        sources = targets(sources.where("weight > 0"), max_repeats).select(F.col("source").alias("of"), "sid", buckets.alias("buckets"), "source_size", "target", "segs", "weight")
        self.sources = common.stored(sources, "sources")
        n, names = self.sources.agg(F.count(F.lit(1)), F.sum(F.octet_length("of"))).first()
        self.few = n <= BROADCAST_SOURCES and (names or 0) <= BROADCAST_NAMES
        cells = self.bucketed(slim).groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.cells = common.stored(cells.withColumn("before", before), "cells")
        self.few_cells = self.cells.count() <= BROADCAST_CELLS

    def _side(self, df: DataFrame, few: bool) -> DataFrame:
        return F.broadcast(df) if few else df

    def bucketed(self, streamed: DataFrame) -> DataFrame:
        """With ``sid`` and ``bucket`` in place of the source."""
        own = self._side(self.sources.select("of", "sid", "buckets"), self.few)
        at = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32))
        return streamed.join(own, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", at).drop("of", "source", "buckets")

    def placed(self, streamed: DataFrame, tasks: int) -> DataFrame:
        """(row, size, source_size, target, copies, positions): the rows move to their cells here."""
        run = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
        moved = self.bucketed(streamed).repartition(tasks, "sid", "bucket").withColumn("run", run)
        moved = moved.join(self._side(self.cells.select("sid", "bucket", "before"), self.few_cells), ["sid", "bucket"])
        moved = moved.join(self._side(self.sources.drop("of", "buckets"), self.few), "sid")
        return self._positions(moved.withColumn("middle", F.col("before") + F.col("run") - F.col("size") / 2)).select("row", "size", "source_size", "target", "copies", "positions")

    def _positions(self, moved: DataFrame) -> DataFrame:
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        rest = F.col("target") - F.col("passes") * F.col("source_size")
        copies = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("middle") < rest, 1).otherwise(0)).otherwise(0)
        share = lambda k: F.least(F.lit(1.0), (F.col("middle") + k * F.col("source_size")) / F.col("target"))
        positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: invert(F.col("segs"), F.col("weight"), share(k)))).otherwise(F.array().cast("array<double>"))
        return moved.withColumn("passes", passes.cast("long")).withColumn("copies", copies.cast("long")).withColumn("positions", positions)

    def grid(self, tasks: int) -> DataFrame:
        """(step, part): training time in ``tasks`` * STEPS steps, cut into ``tasks`` parts of about
        equal words. A cell stands as points along its words: one, and one more for each
        1 / POINTS of a part's words."""
        steps = tasks * STEPS
        cells = self.cells.withColumn("share", F.sum("words").over(Window.partitionBy()) / (POINTS * tasks))
        cells = cells.withColumn("points", 1 + F.floor(F.col("words") / F.greatest("share", F.lit(1.0)))).withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1)))
        cells = cells.withColumn("size", F.col("words") / F.col("points")).join(self._side(self.sources.drop("of", "buckets"), self.few), "sid")
        cells = self._positions(cells.withColumn("middle", F.col("before") + (F.col("point") + 0.5) * F.col("size")))
        words = cells.select("size", F.explode("positions").alias("t")).groupBy(step_of("t", steps).alias("step")).agg(F.sum("size").alias("words"))
        every = cells.sparkSession.range(steps).withColumnRenamed("id", "step").join(words, "step", "left")
        until = F.sum(F.coalesce("words", F.lit(0.0))).over(Window.orderBy("step"))  # over steps, not rows
        every = every.withColumn("until", until).withColumn("all", F.max("until").over(Window.partitionBy()))
        part = F.floor(tasks * (F.col("until") - F.coalesce("words", F.lit(0.0)) / 2) / F.greatest("all", F.lit(1.0)))
        return every.select("step", F.least(part, F.lit(tasks - 1)).cast("int").alias("part"))


def step_of(position: str, steps: int) -> Column:
    return F.least(F.floor(F.col(position) * steps), F.lit(steps - 1)).cast("long")


def tasks_for(docs: DataFrame) -> int:
    """Tasks that move the texts: TASK_BYTES each, but no fewer than shuffles have."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(common.shuffle_partitions(docs.sparkSession), -(-size // TASK_BYTES))


def curriculum(docs: DataFrame, schedules: DataFrame | None = None, ramps: Sequence[tuple[float, float]] = RAMPS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, positions): ``taken`` words
    in ``copies`` copies at ascending training ``positions``. ``schedules``: (source, knots)
    with knots array<struct<t, w>>; without it the sources by code point get ``ramps`` in turn.
    A source without schedule weighs nothing."""
    own = F.struct("doc_id", F.col("source").cast("string").alias("source"))
    streamed = common.stored(_streamed(docs, own), "streams")
    plan = Plan(streamed, schedules, ramps, max_repeats)
    placed = plan.placed(streamed, common.shuffle_partitions(docs.sparkSession))
    return placed.select("row.doc_id", "row.source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by training position; ties by source, then doc_id."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions", "copies", "taken").orderBy("position", F.col("source").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, schedules: DataFrame | None = None, ramps: Sequence[tuple[float, float]] = RAMPS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in training order: partitions
    are ranges of training time with about equal words, sorted by position."""
    streamed = _streamed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    slim = common.stored(streamed.select("source", "order", "size"), "streams")
    plan = Plan(slim, schedules, ramps, max_repeats)
    tasks = tasks_for(docs)
    copies = plan.placed(streamed.where("size > 0"), tasks).select("row", F.explode("positions").alias("position"))
    grid = common.stored(plan.grid(tasks), "grid")  # tasks * STEPS rows of 12 bytes
    steps = tasks * STEPS
    ranged = copies.withColumn("step", step_of("position", steps)).join(F.broadcast(grid), "step").drop("step")
    return ranged.repartitionById(tasks, "part").sortWithinPartitions("position", "row.doc_id").select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS idx,
    (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
found AS (SELECT min(idx) AS idx FROM levels WHERE lvl * weight <= cap),
aims AS (
  SELECT l.source, l.source_size, l.weight, CASE WHEN l.idx >= f.idx THEN (SELECT lvl FROM levels JOIN found USING (idx)) * l.weight ELSE l.cap END AS target
  FROM levels l, found f),
streams AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.weight,
    CASE a.weight WHEN 1 THEN 1.5::DOUBLE ELSE 2::DOUBLE END AS w0, CASE a.weight WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 2::DOUBLE ELSE 4::DOUBLE END AS w1,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) - CAST(s.size AS DOUBLE) / 2 AS middle,
    CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS passes
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
taken AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN passes + CASE WHEN middle < target - passes * source_size THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies,
    CASE WHEN target > 0 THEN least(1, middle / target) * weight END AS passed
  FROM streams)
SELECT doc_id, size, source_size, target, copies * size AS taken,
  CASE WHEN copies > 0 THEN least(1, 2 * passed / (w0 + sqrt(greatest(0, w0 * w0 + 2 * (w1 - w0) * passed)))) END AS first_position
FROM taken
"""
