"""Registered queries of what moves messages in and out: receivers, sinks, queues, metrics,
options and the language itself, as rows with equivalent SQL.

What passes through the driver here are tables of a fixed size (``nation``, ``region``),
or what a query makes itself; ``orders`` goes through the executors only.
"""

from __future__ import annotations

import contextlib
import io
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.templates import parse_template
from ..sources import network
from ..streaming import buffer, engine, metrics, sinks
from . import commands
from .compiler import transform
from .language import ConfigError
from .queries import _EVENTS, _events, registry

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("long").alias(model.SEQ), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("payload"))


def _folder(spark: SparkSession) -> str:
    return f"{engine.shared_folder(spark)}/query-{uuid.uuid4().hex[:12]}"


def _received(spark: SparkSession, make, send, messages: int) -> DataFrame:
    """What ``send`` sends to the receiver that ``make`` makes, read back from its spool."""
    counts = (m := metrics.Metrics()).holder("query")
    receiver = make(f"{_folder(spark)}/spool", buffer=buffer.Buffer(), metrics=m, chunk=7)
    try:
        send(receiver)
        end = time.monotonic() + 30
        while counts.read(False)["messagesReceived"] < messages and time.monotonic() < end:
            time.sleep(0.05)
    finally:
        receiver.stop()
    return network.spooled(spark, receiver.spool.path, stream=False)


def _host(spark: SparkSession) -> str:
    return spark.conf.get("spark.driver.host", "127.0.0.1")


# --- receivers and the sinks that reach them -----------------------------------------------


@query("SELECT n_nationkey + 1 AS place, n_name AS payload, 'tcp' AS transport FROM nation")
def tcp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines over one connection, in order, from the TCP sink to the TCP receiver."""
    df, host = _nations(spark, sf_dir), _host(spark)
    got = _received(spark, lambda p, **kw: network.TcpReceiver((host, 0), "line", p, **kw), lambda r: sinks.to_tcp(df, (host, r.port), give_up=20), df.count())
    first = got.agg(F.min(model.SEQ)).first()[0]  # the spool numbers messages one by one
    return got.select((F.col(model.SEQ) - F.lit(first) + 1).alias("place"), "payload", F.split("from", ":")[0].alias("transport"))


@query("SELECT n_name || chr(10) || 'more' AS payload, 'tcp' AS transport FROM nation")
def tcp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octet-counted frames, whose payloads may hold line ends."""
    df, host = transform(r"set $payload '$payload\nmore'; set $payload syslog-frame", _nations(spark, sf_dir)), _host(spark)
    got = _received(spark, lambda p, **kw: network.TcpReceiver((host, 0), "octet", p, **kw), lambda r: sinks.to_tcp(df, (host, r.port), give_up=20), df.count())
    return got.select("payload", F.split("from", ":")[0].alias("transport"))


@query("SELECT n_name AS payload, 'udp' AS transport FROM nation")
def udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams from the UDP sink to the UDP receiver."""
    df, host = _nations(spark, sf_dir), _host(spark)
    got = _received(spark, lambda p, **kw: network.UdpReceiver((host, 0), p, **kw), lambda r: sinks.to_udp(df, (host, r.port)), df.count())
    return got.select("payload", F.split("from", ":")[0].alias("transport"))


@query("SELECT 'about ' || r_name AS payload, 'tidelog' AS program, CASE WHEN r_regionkey % 2 = 0 THEN '4' ELSE '6' END AS severity FROM region")
def from_internal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's own log as messages."""
    import logging

    rows = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    (log := logging.Logger(f"tidelog.query-{uuid.uuid4().hex[:6]}")).setLevel(logging.INFO)  # not of the root: nothing is printed

    def send(_) -> None:
        for r in rows:
            log.log(logging.WARNING if r["r_regionkey"] % 2 == 0 else logging.INFO, "about %s", r["r_name"])

    # its messages aren't counted as received from a transport: the spool's end is awaited
    return _received(spark, lambda p, **kw: network.LogReceiver(log, p, **kw), send, 0).select("payload", "program", "severity")


# --- sinks -----------------------------------------------------------------------------------


@query("SELECT o_orderpriority[1] AS file, o_orderkey || ' ' || o_orderstatus AS line FROM orders")
def to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each priority; the batch comes twice, as after a crash, and is there once."""
    folder = _folder(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias(model.SEQ), F.left("o_orderpriority", F.lit(1)).alias("level"), F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("payload"))
    for _ in range(2):
        sinks.to_file(o, parse_template(f"{folder}/p-$level.log").column(o), writer=("query", "0", 0))
    return spark.read.text(f"{folder}/*.log").select(F.regexp_extract(F.input_file_name(), r"p-(.)\.log$", 1).alias("file"), F.col("value").alias("line"))


@query("SELECT 'to ' || n_name AS line FROM nation")
def to_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through a child process, which lives until it is closed."""
    import os

    os.makedirs(folder := _folder(spark))
    command = f"sh -c 'sed \"s/^/to /\" > {folder}/out.txt'"
    sinks.to_shell(_nations(spark, sf_dir), command)
    sinks.ShellSink._held.pop(command).close()
    return spark.read.text(f"{folder}/out.txt").select(F.col("value").alias("line"))


@query("SELECT n_nationkey AS place, n_name AS line FROM nation")
def to_stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    sinks.to_stdout(_nations(spark, sf_dir), out)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "place long, line string")


@query("SELECT n_nationkey * 3 + i AS place, n_nationkey || '> ' || CASE i WHEN 0 THEN '#' || n_nationkey WHEN 1 THEN '$key=' || n_nationkey ELSE '$payload=' || n_name END AS line FROM nation, range(3) t(i)")
def dump_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages on the console, each line behind the message's own prefix."""
    _, found = engine.run_batch(spark, "dump '$key> '", {}, _nations(spark, sf_dir))
    with contextlib.redirect_stdout(out := io.StringIO()):
        engine.deliver(*found[0])
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "place long, line string")


@query("SELECT n_name AS line FROM nation WHERE n_nationkey % 2 = 0")
def to_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = engine.run_batch(spark, f"switch $key {{ case ~[13579]$~ {{drop}} }} to mock {(name := 'q' + uuid.uuid4().hex)};", {}, _nations(spark, sf_dir))
    engine.deliver(*found[0])
    return spark.createDataFrame([(x,) for x in sinks.MemorySink._held.pop(name)], "line string")


# --- queues ------------------------------------------------------------------------------------


@query("""SELECT 'off' AS mode, range AS id, 1880 AS lost FROM range(2000) WHERE range < 10 OR range >= 1890
UNION ALL SELECT 'fast', range, 0 FROM range(2000)""")
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 messages in chunks of ten, which take 100 bytes packed: with room for ten chunks the
    oldest between the first and the last are lost; with enough room none, compressed or not."""
    rows: list[tuple[str, int, int]] = []
    for mode, limit in (("off", 1000), ("fast", 1 << 20)):
        q, ids = buffer.Queue(buffer.Buffer(limit, mode), 10), []
        for i in range(2000):
            q.put({"payload": b"%08d" % i})
        while part := q.take():
            ids += [int(m["payload"]) for m in part]
        rows += [(mode, i, q.overflow) for i in ids]
    return spark.createDataFrame(rows, "mode string, id long, lost int")


# --- metrics -------------------------------------------------------------------------------------


def _measured(spark: SparkSession, sf_dir: str) -> metrics.Metrics:
    """Metrics after all documents went to files and all conversations came from TCP."""
    (m := metrics.Metrics()).holder("query")
    for transport, table in (("toFile", "documents"), ("fromTcp", "conversations")):
        m.transfer(transport, *metrics.transfer_stats(spark.read.parquet(f"{sf_dir}/{table}.parquet"), "text").first())
    return m


_MOVED = "moved AS (SELECT 'toFile' AS way, 'messagesSent' AS whole, text FROM documents UNION ALL SELECT 'fromTcp', 'messagesReceived', text FROM conversations), counted AS (SELECT way, whole, count(*) AS n, sum(octet_length(encode(coalesce(text, '')))) AS bytes, max(octet_length(encode(coalesce(text, '')))) AS most FROM moved GROUP BY way, whole)"


@query(f"""WITH {_MOVED}, found AS (SELECT way || 'Messages' AS name, n FROM counted UNION ALL SELECT way || 'TotalBytes', bytes FROM counted UNION ALL SELECT whole, n FROM counted),
named AS (SELECT 'tidelog_' || lower(regexp_replace(name, '([A-Z])', '_\\1', 'g')) AS name, n FROM found)
SELECT '# TYPE ' || name || ' counter' AS line FROM named UNION ALL SELECT name || ' ' || n FROM named""")
def prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters as Prometheus reads them, two reads without a reset; largest values are left out."""
    m = _measured(spark, sf_dir)
    m.snapshot("query", reset=False)
    moved = {k: v for k, v in m.snapshot("query", reset=False).items() if v and k not in metrics.GAUGES}
    return spark.createDataFrame([(x,) for x in metrics.prometheus(moved).splitlines()], "line string")


@query(f"""WITH {_MOVED}, t AS (SELECT * FROM counted WHERE way = 'fromTcp'), f AS (SELECT * FROM counted WHERE way = 'toFile')
SELECT r_name AS name, 'tidelog,name=' || replace(r_name, ' ', '') || ' fromTcpMaxBytes=' || t.most || ',fromTcpMessages=' || t.n || ',fromTcpTotalBytes=' || t.bytes ||
  ',messagesReceived=' || t.n || ',messagesSent=' || f.n || ',toFileMaxBytes=' || f.most || ',toFileMessages=' || f.n || ',toFileTotalBytes=' || f.bytes || ' 42' AS line,
  CAST(f.n AS VARCHAR) AS sent, '0' AS again FROM region, t, f""")
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as fields and as a line of a time series; a parser's read resets what it reads."""
    m, regions = _measured(spark, sf_dir), spark.read.parquet(f"{sf_dir}/region.parquet")
    first = {k: v for k, v in m.snapshot("query").items() if v and k not in metrics.GAUGES}
    second = m.snapshot("query")
    df = regions.select("r_name", F.replace("r_name", F.lit(" "), F.lit("")).alias("name"))
    out = transform("parse engine-stats", df.select("name"), snapshots=lambda consumer: first, nanos=42)
    return df.join(out.select("name", F.col("influxLineProtocolPayload").alias("line"), F.col("messagesSent").alias("sent")), "name").select(F.col("r_name").alias("name"), "line", "sent", F.lit(str(second["messagesSent"])).alias("again"))


@query("""WITH v AS (SELECT * FROM (VALUES (0, 0, '0'), (1, 1000, '1000'), (2, 1572864, '1.5M'), (3, 104858000, '100M'), (4, 5368709120, '5G')) t(n, v, size))
SELECT n, size || ' ' || CASE v WHEN 0 THEN '0s' ELSE CASE WHEN v >= 86400 THEN v // 86400 || 'd' ELSE '' END || CASE WHEN v % 86400 >= 3600 THEN v % 86400 // 3600 || 'h' ELSE '' END ||
  CASE WHEN v % 3600 >= 60 THEN v % 3600 // 60 || 'm' ELSE '' END || CASE WHEN v % 60 > 0 THEN v % 60 || 's' ELSE '' END END AS text FROM v""")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and times in units that people read."""
    values = (0, 1000, 1_572_864, 104_858_000, 5 << 30)
    return spark.createDataFrame([(i, metrics.summary({"someBytes": v, "tookSeconds": v}).replace("some ", "").replace("took ", "")) for i, v in enumerate(values)], "n long, text string")


# --- options and language --------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT event_id, strftime(CAST(left(date, 19) AS TIMESTAMP) + INTERVAL 345 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:45' AS at, strftime(CAST(left(date, 19) AS TIMESTAMP) + INTERVAL 345 MINUTE, '%H:%M') || ' Asia/Kathmandu' AS clock FROM e")
def zone_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone in which the present time is told; each event's time is the present here."""
    e = _events(spark, sf_dir)
    now = F.to_timestamp(F.left("date", F.lit(19)), "yyyy-MM-dd'T'HH:mm:ss")
    return transform("create_dates_in_timezone Asia/Kathmandu; set $at date as datetime; set $clock date as 'HH:mm VV'", e, now=now).select("event_id", "at", "clock")


@query("""SELECT * FROM (VALUES ('queue_chunk_messages', '2048', '500'), ('zone', 'Asia/Kathmandu', 'UTC'), ('prometheus', 'metrics:9100', ''), ('buffer_bytes', '3145728', '134217728'), ('compression', 'off', 'fast')) t(name, given, otherwise)""")
def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options of a program, and what they are without it."""
    text = "queue_chunk_messages 2k; create_dates_in_timezone Asia/Kathmandu; prometheus_metrics_http_address metrics:9100; buffer { memory_bytes 3m; memory_compression off }"
    given, otherwise = (vars(commands.read_program(t).options) for t in (text, ""))
    show = lambda v: "" if v is None else ":".join(map(str, v)) if isinstance(v, tuple) else str(v)
    return spark.createDataFrame([(k, show(given[k]), show(otherwise[k])) for k in given], "name string, given string, otherwise string")


@query(r"""SELECT * FROM (VALUES (0, 'parse json;'), (1, 'switch $level {'), (2, '    case ~^err~i {'), (3, '        set $payload ''it\''s $level'';'), (4, '        to stdout;'), (5, '    }'), (6, '    default {'), (7, '        drop;'), (8, '    }'), (9, '}')) t(n, line)""")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program as the engine prints it."""
    text = r"parse json # as it comes" + "\n" + r";switch $level{case ~^err~i {set $payload 'it\'s $level';to stdout} default{drop}}"
    return spark.createDataFrame(list(enumerate(commands.read_program(text).canonical().splitlines())), "n long, line string")


@query("""SELECT * FROM (VALUES ('to nowhere', 1), ('drop;' || chr(10) || 'keep', 2), ('tee {' || chr(10) || chr(10) || 'from udp x}', 3), ('set $a ''', 1), ('drop }', 1), ('from tcp 7; from tcp 7 as syslog-frame', 0)) t(text, line)""")
def located_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that are refused, and the line at fault (0, where two places are)."""
    import re

    rows = []
    for text in ("to nowhere", "drop;\nkeep", "tee {\n\nfrom udp x}", "set $a '", "drop }", "from tcp 7; from tcp 7 as syslog-frame"):
        try:
            commands.read_program(text, "here")
        except ConfigError as e:
            place = re.search(r"\[here:(\d+)\]$", str(e))
            rows.append((text, int(place[1]) if place else 0))
    return spark.createDataFrame(rows, "text string, line int")


@query(f"""WITH {_EVENTS} SELECT event_id, event_type || chr(9) || '"' || chr(10) || '$amount' AS line, CASE WHEN event_type IN ('error', 'view') THEN 'SEEN' ELSE event_type END AS found FROM e""")
def escapes_and_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes in either kind of quotes; a regular expression that ignores case and blanks."""
    return transform(r"""set $line "$event_type\t\"\n\$amount"; set $found replace ~ ^ (?: ERR or | View ) $ ~ix 'SEEN' in $event_type""", _events(spark, sf_dir)).select("event_id", "line", "found")
