"""The engine: validate, explain, run on batches, and run as Structured Streaming.

Each top-level stream of a program (its own commands, and every isolated ``flow``) is
one streaming query: its sources are united, tagged, and lowered per micro-batch, where
all its sinks are served from one cached frame; a source is read once however many sinks
there are, and flows can't hold one another up.
"""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..plans import commands as c
from ..plans.compiler import Lowering
from ..plans.language import ConfigError
from ..sources import network, tables
from . import sinks
from .buffer import Buffer
from .metrics import Metrics, PrometheusServer

_log = logging.getLogger("tidelog.engine")
#: Settings that the semantics need.
SETTINGS = {"spark.sql.caseSensitive": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC"}


def configured(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, where that is a path; a folder of this machine otherwise."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").rstrip("/")
    return shared if shared and "://" not in shared else tempfile.mkdtemp(prefix="tidelog-")


def validate(text: str, spark: SparkSession | None = None, dialect: c.Dialect | None = None) -> str | None:
    """The error of a pipeline text, or None."""
    try:
        c.read_program(text, dialect=dialect, spark=spark)
    except ConfigError as e:
        return str(e)
    return None


def _isolated(body: tuple) -> tuple[list[tuple], tuple]:
    """Bodies of all flows at any depth outside branches, and the rest."""
    flows, rest = [], []
    for x in body:
        if isinstance(x, c.Block):
            inner, own = _isolated(x.body)
            flows += inner
            if x.kind == "flow":
                flows.append(own)
                continue
            x = replace(x, body=own)
        rest.append(x)
    return flows, tuple(rest)


def streams(program: c.Program) -> list[tuple]:
    """The bodies that run as queries of their own: those that have a source."""
    flows, rest = _isolated(program.body)
    return [b for b in [*flows, rest] if program.sources(b)]


def run_batch(spark: SparkSession, text: str, inputs: dict[str, DataFrame] | Callable[[c.From], DataFrame], df: DataFrame | None = None, dialect: c.Dialect | None = None, **kw) -> tuple[DataFrame | None, list[tuple[c.To, DataFrame]]]:
    """The whole program on batches: (what leaves it, [(sink, its messages)]). ``inputs``: frames
    by source kind or name (``udp``, ``mock``, a table's name), or a function of the source."""
    configured(spark)
    dialect = dialect or c.Dialect()
    program = c.read_program(text, dialect=dialect, spark=spark)
    given = inputs if callable(inputs) else lambda s: inputs.get(s.name) if s.kind in ("table", "mock") and s.name in inputs else inputs.get(s.kind)
    lowering = Lowering(given, program.options, dialect, **kw)
    out = lowering.run(program.body, df)
    return out, lowering.sinks


def explain(spark: SparkSession, text: str, df: DataFrame) -> str:
    """The canonical text and Spark's plan of a pipeline on ``df``."""
    out, to = run_batch(spark, text, lambda s: df, df)
    program = c.read_program(text, spark=spark)
    parts = [program.canonical()]
    for name, frame in [("out", out), *((t.kind, d) for t, d in to)]:
        if frame is not None:
            parts.append(f"-- {name}\n" + frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    return "\n".join(parts)


def deliver(sink: c.To, df: DataFrame, metrics: Metrics | None = None, writer: tuple[str, str, int] | None = None) -> int:
    """Serve one sink. ``writer``: see ``sinks.to_file``."""
    if sink.kind == "stdout":
        return sinks.to_stdout(df)
    if sink.kind == "dump":
        from ..functions.fields import dump

        text = dump(df)
        if sink.template is not None:  # before each line
            prefix = sink.template.column(df)
            text = F.concat(prefix, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), prefix)))
        return sinks.to_stdout(df.withColumn("payload", text))
    if sink.kind == "file":
        return sinks.to_file(df, sink.template.column(df), metrics, writer)
    if sink.kind == "udp":
        return sinks.to_udp(df, sink.address, metrics)
    if sink.kind == "tcp":
        return sinks.to_tcp(df, sink.address, metrics)
    if sink.kind == "shell":
        return sinks.to_shell(df, sink.name, metrics)
    return sinks.MemorySink.write(df, sink.name)


class Engine:
    """A running program. ``table_stream`` gives the stream of a ``from table`` source."""

    def __init__(self, spark: SparkSession, text: str, work: str | None = None, dialect: c.Dialect | None = None, trigger: str = "200 milliseconds", table_stream: Callable[[str], DataFrame] | None = None):
        self.spark, self.dialect, self.trigger, self.table_stream = configured(spark), dialect or c.Dialect(), trigger, table_stream
        self.work = work or f"{shared_folder(spark)}/engine-{uuid.uuid4().hex[:12]}"
        self.metrics, self.queries, self.server, self._served, self._generation = Metrics(spark), [], None, None, 0
        self.program = c.read_program(text, dialect=self.dialect, spark=spark)
        o = self.program.options
        self.buffer = Buffer(o.buffer_bytes, o.compression, self.metrics)
        self.listeners = network.Listeners(f"{self.work}/spool", self.buffer, self.metrics, o.queue_chunk_messages, o.zone)

    def _receiver(self, s: c.From) -> network.Receiver:
        if s.kind == "udp":
            return self.listeners.udp(s.address)
        if s.kind == "tcp":
            return self.listeners.tcp(s.address, s.framing)
        return self.listeners.log() if s.kind == "internal-log" else self.listeners.memory(s.name)

    def _stream(self, s: c.From) -> DataFrame:
        if s.kind == "timer":
            return tables.timer(self.spark, seconds=s.number, zone=self.program.options.zone)
        if s.kind == "infinity":
            return tables.infinity(self.spark, length=s.number, zone=self.program.options.zone)
        if s.kind == "table":
            return self.table_stream(s.name)
        return network.spooled(self.spark, self._receiver(s).spool.path)

    def start(self) -> Engine:
        for x in self.program.commands():
            if isinstance(x, c.Parse) and x.kind == "stats":
                self.metrics.holder(x.consumer)  # counts from now on
        for i, body in enumerate(streams(self.program)):
            found = list(dict.fromkeys(s.key for s in self.program.sources(body)))
            by_key = {s.key: s for s in self.program.sources(body)}
            united = None
            for j, key in enumerate(found):
                united = model.union(united, self._stream(by_key[key]).withColumn("_source", F.lit(j)))
            self.queries.append(united.writeStream.foreachBatch(self._batch(body, found)).option("checkpointLocation", f"{self.work}/checkpoint-{self._generation}-{i}").trigger(processingTime=self.trigger).start())
        wanted = self.program.options.prometheus
        if self.server is not None and wanted != self._served:
            self.server.stop()
            self.server = None
        if wanted and self.server is None:
            self.server, self._served = PrometheusServer(self.metrics, *wanted), wanted
        return self

    def _batch(self, body: tuple, found: list[tuple]) -> Callable[[DataFrame, int], None]:
        def run(df: DataFrame, number: int) -> None:
            df = df.persist()
            try:
                source = lambda s: df.where(F.col("_source") == found.index(s.key)).drop("_source")
                parsed: list[tuple[DataFrame, DataFrame]] = []
                lowering = Lowering(source, self.program.options, self.dialect, snapshots=self.metrics.snapshot, on_drop=lambda *pair: parsed.append(pair))
                lowering.run(body)
                stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # outlives restarts
                for i, (sink, out) in enumerate(lowering.sinks):
                    deliver(sink, out, self.metrics, stream and (stream, str(i), number))
                if self.metrics.wanted:  # counted from the cached batch, and only if somebody reads it
                    for before, after in parsed:
                        self.metrics.add("unparsedDropped", before.count() - after.count())
            finally:
                df.unpersist()

        return run

    def reload(self, text: str) -> bool:
        """Swap in another program; an invalid one changes nothing. Sources queue meanwhile."""
        try:
            program = c.read_program(text, dialect=self.dialect, spark=self.spark)
        except ConfigError as e:
            _log.error("%s", e)
            return False
        for r in self.listeners._held.values():
            r.spool.paused.set()
        self._stop_queries()
        self.program, self._generation = program, self._generation + 1
        self.start()
        used = {("udp", *s.address) if s.kind == "udp" else ("tcp", *s.address) if s.kind == "tcp" else ("log",) if s.kind == "internal-log" else ("mock", s.name) for s in program.sources()}
        self.listeners.drop_unused(used)
        for r in self.listeners._held.values():
            r.spool.paused.clear()
        self.metrics.add("configReloads")
        return True

    def _stop_queries(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries = []

    def stop(self) -> None:
        self._stop_queries()
        self.listeners.stop()
        if self.server:
            self.server.stop()
