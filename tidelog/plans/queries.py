"""The registered queries of the engine's own operators, with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import fields, packs
from ..functions.regexps import Regexp
from ..functions.templates import parse_template
from ..operators import parse, route
from ..sources import network, tables
from ..streaming import buffer, metrics
from .compiler import transform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registry(queries: dict, oracles: dict) -> Callable:
    """A decorator that registers a query by its name, with its SQL."""

    def query(sql: str | None):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return register

    return query


query = registry(QUERIES, ORACLES)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: id, kind, money as text with two digits, JSON payload, ISO date."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    local, offset = e["ts"], F.lit("+00:00")
    return e.select(F.col("event_id").alias(model.SEQ), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type"), F.col("value").cast("decimal(18,2)").cast("string").alias("amount"), fields.format_time("datetime", local, offset).alias("date"), F.col("props").alias("payload"))


_EVENTS = "e AS (SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date, props AS payload FROM events)"


@query(f"""WITH {_EVENTS}, l AS (
  SELECT *, CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k,
    CASE event_type WHEN 'error' THEN '3' WHEN 'signup' THEN '5' ELSE '6' END AS severity FROM e)
SELECT event_id, '/logs/shop-' || user_id || '/' || event_type || '.log' AS file,
  CASE WHEN event_type = 'view' THEN 'no' ELSE 'syslog' END AS handled,
  date || ' agent-1 ' || CASE WHEN event_type = 'view' THEN '-' ELSE event_id END || ' ' ||
  CASE WHEN event_type = 'view' THEN '' WHEN severity = '3' THEN 'ERR' WHEN severity = '5' THEN 'NOTICE' ELSE 'INFO' END || ' ' ||
  CASE WHEN event_type = 'view' THEN '{{"k": ' || k || '}}' ELSE 'amount=' || amount || ' k=' || k END AS payload
FROM l""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent and collector: events wrapped as syslog lines in JSON, then unwrapped by type,
    reformatted, and given a file name; one narrow stage."""
    agent = transform(
        r"""
        set $program $event_type; set $pid $event_id; set $facility '1'; set $host '/srv/shop-$user_id';
        parse keep-unparsed ~"k":\s*(?<k>\d+)~;
        switch $event_type { case error {set $severity '3'} case signup {set $severity '5'} default {set $severity '6'} }
        set $agent_type 'udp-syslog';
        switch $event_type {
            case view { set $agent_type 'udp-plain'; }
            default { set $payload 'amount=$amount k=$k'; set $payload syslog; }
        }
        set $from_host $host; set $host 'agent-1';
        set $payload json $agent_type $date $host $from_host $event_id $program $payload;
        keep $payload;
        """,
        _events(spark, sf_dir),
    )
    keys = ["agent_type", "date", "host", "from_host", "event_id", "program", "payload"]
    collected = transform(
        r"""
        parse json; set $agent_host $host; set $handled 'no'; set $host $from_host;
        switch $agent_type { case ~-syslog$~ { parse syslog; set $handled 'syslog'; } }
        set $pid replace ~^$~ '-' in $pid;
        set $level severity-name $severity;
        set $payload '$date $agent_host $pid $level $payload';
        set $host basename $host; set $program basename $program;
        set $file '/logs/$host/$program.log';
        keep $event_id $file $handled $payload;
        """,
        agent,
        json_keys=keys,
    )
    return collected.select("event_id", "file", "handled", "payload")


@query(f"WITH {_EVENTS} SELECT event_id, json_extract_string(payload, '$.k') AS k FROM e")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.json_fields(_events(spark, sf_dir).select("event_id", "payload"), keys=["k"]).select("event_id", "k")


@query(f"WITH {_EVENTS} SELECT event_id, amount || '0' AS a, event_id || 'e3' AS b, '-0.50' AS c, 'say \"1.0\": 2.50' AS d, 'true' AS e FROM e")
def parse_json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers keep their text; a number in a string is left alone."""
    df = transform(r"""set $payload '{"a": ${amount}0, "b":${event_id}e3 , "c":-0.50, "d": "say \\"1.0\\": 2.50", "e": true, "f": null}'""".replace("${amount}", "{$amount}").replace("${event_id}", "{$event_id}"), _events(spark, sf_dir))
    return parse.json_fields(df.select("event_id", "payload"), keys=["a", "b", "c", "d", "e"]).select("event_id", "a", "b", "c", "d", "e")


@query(f"WITH {_EVENTS} SELECT event_id, json_extract_string(payload, '$.k') AS k FROM e WHERE event_type NOT IN ('error', 'view', 'click')")
def parse_json_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no flat object and nothing else is dropped: text after it, an array, a nested value."""
    df = transform(r"""switch $event_type {
        case error { set $payload '$payload x'; } case view { set $payload '[$payload]'; } case click { set $payload '{"k": $payload}'; }
    }""", _events(spark, sf_dir).select("event_id", "event_type", "payload"))
    return parse.json_fields(df, keys=["k"]).select("event_id", "k")


@query(f"WITH {_EVENTS} SELECT event_id, strftime(CAST(left(date, 19) AS TIMESTAMP), '%d/%m/%Y %H.%M.%S') || ' +0230' AS at, strftime(CAST(left(date, 19) AS TIMESTAMP), '%H:%M:%S') AS clock, CAST(CAST(epoch(CAST(left(date, 19) AS TIMESTAMP)) AS BIGINT) - 9000 AS VARCHAR) || '000' AS ms, CAST(CAST(epoch(CAST(left(date, 19) AS TIMESTAMP)) AS BIGINT) - 9000 AS VARCHAR) || '000000' AS us FROM e")
def time_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as access logs write them, in other forms; the offset stays."""
    e = _events(spark, sf_dir)
    local = F.to_timestamp(F.left("date", F.lit(19)), "yyyy-MM-dd'T'HH:mm:ss")
    df = e.withColumn("date", F.concat(F.date_format(local, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0230")))
    return transform("set $at date as 'dd/MM/yyyy HH.mm.ss Z' in $date; set $clock date as time in $date; set $ms date as unixtime-milliseconds in $date; set $us date as unixtime-microseconds in $date", df).select("event_id", "at", "clock", "ms", "us")


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y') || ' 0 ' || strftime(ts, '%y') AS year, CAST(datediff('day', DATE '1858-11-17', CAST(ts AS DATE)) AS VARCHAR) AS day,
  lpad(CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS VARCHAR), 9, '0') AS ms, '-03:30 at -03:30' AS zone FROM events""")
def time_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that Spark's own patterns don't know."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:30")).alias("at"))
    return transform("set $year date as 'uuuu n uu' in $at; set $day date as g in $at; set $ms date as AAAAAAAAA in $at; set $zone date as \"VV 'at' z\" in $at", e).select("event_id", "year", "day", "ms", "zone")


@query(f"WITH {_EVENTS} SELECT event_id, '{fields.host()}' AS here, '' AS missing, '{fields.host()} ' || event_type AS line FROM e")
def host_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transform("set $here host; set $missing env TIDELOG_NO_SUCH_VARIABLE; set $line '$here $event_type'", _events(spark, sf_dir))
    return df.select("event_id", "here", F.coalesce("missing", F.lit("")).alias("missing"), "line")


@query(f"WITH {_EVENTS} SELECT event_id, json_extract_string(payload, '$.k') AS k FROM e")
def parse_json_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown members go to the map column and are read from it."""
    got = transform("parse json; keep $event_id $k", _events(spark, sf_dir).select("event_id", "payload"))
    return got.select("event_id", "k")


@query(f"WITH {_EVENTS} SELECT event_id, 'user=' || user_id || ' did ' || event_type || 's for ' || amount AS line FROM e")
def set_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform("set $line 'user=$user_id did {$event_type}s for $amount'", _events(spark, sf_dir)).select("event_id", "line")


@query(r"""SELECT CAST(page_id AS VARCHAR) AS page_id, regexp_extract(url, '^(https?)://([^/]+)/', 1) AS scheme,
  regexp_extract(url, '^(https?)://([^/]+)/', 2) AS site FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/')""")
def parse_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("payload"))
    return parse.regexp(pages, Regexp("^(?<scheme>https?)://(?<site>[^/]+)/")).select("page_id", "scheme", "site")


@query(r"SELECT CAST(page_id AS VARCHAR) AS page_id, regexp_replace(url, '/([a-z]{2})/', '/[\1]/', 'g') AS link FROM pages")
def replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("page_id"), "url")
    return transform("set $link replace ~/([a-z]{2})/~ '/[$1]/' in $url", pages).select("page_id", "link")


@query(f"""WITH {_EVENTS} SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'alarm' WHEN regexp_matches(event_type, '^(pur|sig)') THEN 'sale' ELSE 'rest' END AS kind,
  CASE WHEN regexp_matches(event_type, '^(pur|sig)') AND event_type <> 'error' THEN regexp_extract(event_type, '^(pur|sig)', 1) END AS head
FROM e WHERE event_type <> 'click'""")
def switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches narrow: guarded writes in one projection."""
    return transform("switch $event_type { case error {set $kind alarm} case ~^(?<head>pur|sig)~ {set $kind sale} case click {drop} default {set $kind rest} }", _events(spark, sf_dir)).select("event_id", "kind", "head")


@query(f"""WITH {_EVENTS} SELECT event_id, event_type, 'x' AS mark FROM e WHERE event_type = 'error'
UNION ALL SELECT NULL, 'extra', NULL FROM range(3) UNION ALL SELECT event_id, event_type, NULL FROM e WHERE event_type <> 'error'""")
def switch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch with a source of its own: rows are split by branch and united."""
    extra = spark.range(3).select(F.lit("extra").alias("event_type"))
    out = transform("switch $event_type { case error { set $mark x; join {from mock} } }", _events(spark, sf_dir), sources=lambda s: extra)
    return out.select("event_id", "event_type", "mark")


@query(f"""WITH {_EVENTS} SELECT event_id, CAST(to_json({{'amount': amount, 'date': date, 'event_id': event_id, 'event_type': event_type, 'user_id': user_id}}) AS VARCHAR) AS line FROM e""")
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform("set $payload ''; set $line json; keep $event_id $line", _events(spark, sf_dir)).select("event_id", "line")


@query("SELECT doc_id, CAST(to_json({'text': text, 'none': ''}) AS VARCHAR) AS line FROM documents")
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", fields.to_json(docs, ["text", "none"]).alias("line"))


@query("SELECT doc_id, octet_length(encode(text)) || ' ' || text AS frame FROM documents")
def syslog_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("payload"))
    return docs.select("doc_id", fields.syslog_frame(docs).alias("frame"))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS dt,
  CAST(epoch_us(date_trunc('second', ts)) // 1000000 - 19800 AS VARCHAR) AS s, CAST((epoch_us(date_trunc('second', ts)) // 1000000 - 19800) * 1000000000 AS VARCHAR) AS ns,
  strftime(ts, '%d/%b/%Y %H') || 'h +0530' AS own FROM events""")
def time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("at"))
    return transform("set $t time in $at; set $d date in $at; set $dt date as datetime in $at; set $s date as unixtime-seconds in $at; set $ns date as unixtime-nanoseconds in $at; set $own date as \"dd/MMM/yyyy HH'h' Z\" in $at", e).select("event_id", "t", "d", "dt", "s", "ns", "own")


@query(r"""SELECT CAST(page_id AS VARCHAR) AS page_id,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '^.*[/\\:;]', ''), '^(\.\.|\.|~|\|)$|^~', ''), ''), 'noname') AS base FROM pages""")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("page_id"), "url")
    return transform("set $base basename $url", pages).select("page_id", "base")


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '0' THEN 'emerg' WHEN '1' THEN 'alert' WHEN '2' THEN 'crit' WHEN '3' THEN 'err' WHEN '4' THEN 'warning' WHEN '5' THEN 'notice' ELSE left(o_orderpriority, 1) END AS name FROM orders""")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("level"))
    return o.select("o_orderkey", fields.severity_name(F.col("level"), lowercase=True).alias("name"))


@query("""SELECT role, count(*) AS messages, CAST(max(octet_length(encode(text))) AS BIGINT) AS max_bytes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM conversations GROUP BY role""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.max(size).cast("long").alias("max_bytes"), F.sum(size).cast("long").alias("total_bytes"))


@query("SELECT count(*) AS messages, CAST(max(octet_length(encode(text))) AS BIGINT) AS max_bytes, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents")
def transfer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.transfer_stats(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("payload")))


@query("""WITH n AS (SELECT event_id, event_id // 100 AS chunk, octet_length(encode(props)) AS bytes FROM events),
c AS (SELECT chunk, sum(bytes) AS bytes FROM n GROUP BY chunk), m AS (SELECT *, min(chunk) OVER () AS lo, max(chunk) OVER () AS hi FROM c),
h AS (SELECT chunk, sum(bytes) OVER (ORDER BY chunk DESC) AS held FROM m WHERE chunk > lo AND chunk < hi)
SELECT event_id FROM n WHERE chunk IN (SELECT chunk FROM h WHERE held <= 20000) OR chunk IN (SELECT chunk FROM m WHERE chunk = lo OR chunk = hi)""")
def overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return buffer.survivors(e, F.col("event_id"), F.octet_length("props"), 20_000, 100).select("event_id")


@query(f"""WITH {_EVENTS} SELECT 'event_id' AS key, event_id AS value FROM e UNION ALL SELECT 'user_id', user_id FROM e UNION ALL SELECT 'event_type', event_type FROM e
UNION ALL SELECT 'amount', amount FROM e WHERE amount <> '' UNION ALL SELECT 'date', date FROM e UNION ALL SELECT 'payload', payload FROM e WHERE payload <> ''""")
def each_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform("parse each-field-as-message", _events(spark, sf_dir)).select("key", "value")


@query(f"WITH {_EVENTS} SELECT event_id, user_id FROM e WHERE event_type <> 'error'")
def keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform("switch $event_type { case error {drop} } keep $event_id $user_id $nothing", _events(spark, sf_dir)).select("event_id", "user_id")


@query(f"WITH {_EVENTS} SELECT event_id, CAST(NULL AS VARCHAR) AS user_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type FROM e")
def unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform("set $user_id ''; switch $event_type { case view {set $event_type ''} }", _events(spark, sf_dir)).select("event_id", "user_id", "event_type")


@query(f"""WITH {_EVENTS} SELECT event_id, CAST(NULL AS VARCHAR) AS role, payload FROM e
UNION ALL SELECT NULL, role, text FROM conversations""")
def join_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.col("text").alias("payload"))
    return transform("join {from mock}", _events(spark, sf_dir), sources=lambda s: talks).select("event_id", "role", "payload")


@query(f"""WITH {_EVENTS} SELECT 'tee' AS branch, 'copy of ' || event_id AS line FROM e UNION ALL SELECT 'out', event_id FROM e""")
def tee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both consumers of the forked stream, tagged."""
    from ..streaming.engine import run_batch

    out, sinks = run_batch(spark, "tee {set $line 'copy of $event_id'; to mock;} set $line $event_id;", {}, _events(spark, sf_dir))
    return sinks[0][1].select(F.lit("tee").alias("branch"), "line").unionByName(out.select(F.lit("out").alias("branch"), "line"))


@query(f"""WITH {_EVENTS} SELECT 'flow' AS branch, count(*) AS n FROM conversations UNION ALL SELECT 'out', count(*) FROM e""")
def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An isolated flow neither sees nor adds to the main stream."""
    from ..streaming.engine import run_batch

    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("text").alias("payload"))
    out, sinks = run_batch(spark, "flow {from mock; to mock}", {"mock": talks}, _events(spark, sf_dir))
    return sinks[0][1].agg(F.count(F.lit(1)).alias("n")).select(F.lit("flow").alias("branch"), "n").unionByName(out.agg(F.count(F.lit(1)).alias("n")).select(F.lit("out").alias("branch"), "n"))


@query(f"""WITH {_EVENTS} SELECT event_id, date, '1' AS facility, '6' AS severity, 'h' || user_id AS host, event_type AS program, event_id AS pid, payload FROM e""")
def syslog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "set $host 'h$user_id'; set $program $event_type; set $pid $event_id; set $payload syslog; keep $event_id $payload; parse syslog"
    return transform(text, _events(spark, sf_dir)).select("event_id", "date", "facility", "severity", "host", "program", "pid", "payload")


@query(f"""WITH {_EVENTS} SELECT event_id, '10' AS facility, '5' AS severity, CASE WHEN event_type <> 'view' THEN 'web-3' END AS host, event_type AS program, payload FROM e""")
def syslog_bsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "switch $event_type { case view {set $payload '<85>Mar 17 08:15:02 $event_type: $payload'} default {set $payload '<85>Mar  7 08:15:02 web-3 $event_type: $payload'} } keep $event_id $payload; parse syslog"
    return transform(text, _events(spark, sf_dir)).select("event_id", "facility", "severity", "host", "program", "payload")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def fieldpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    packed = c.select(packs.pack(c).alias("payload"))
    return parse.pack(packed, keys=["id", "name", "segment"]).select("id", "name", "segment")


@query(f"""WITH {_EVENTS} SELECT event_id, '#' || seq || chr(10) || '$amount=' || amount || chr(10) || '$date=' || date || chr(10) || '$event_id=' || event_id || chr(10) || '$event_type=' || event_type || chr(10) || '$payload=' || payload || chr(10) || '$user_id=' || user_id AS text FROM e""")
def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", fields.dump(e).alias("text"))


@query(f"""WITH {_EVENTS} SELECT event_id, 'tidelog,event_type=' || event_type || ',user_id=' || user_id || ' messagesReceived=7,uptimeSeconds=5 123' AS line FROM e""")
def influx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    both = parse.stats(e.select(model.SEQ, "event_type", "user_id"), {"messagesReceived": 7, "uptimeSeconds": 5}, now_nanos=123)
    return both.select(F.col(model.SEQ).cast("string").alias("event_id"), F.col("influxLineProtocolPayload").alias("line"))


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN regexp_matches(text, '^[A-Z][a-z]+ [a-z]+') THEN regexp_extract(text, '^([A-Z][a-z]+) ([a-z]+)', 1) END AS head,
  CASE WHEN regexp_matches(text, '^[A-Z][a-z]+ [a-z]+') THEN regexp_extract(text, '^([A-Z][a-z]+) ([a-z]+)', 2) END AS next FROM documents""")
def keep_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("payload"))
    return transform("parse keep-unparsed ~^(?<head>[A-Z][a-z]+) (?<next>[a-z]+)~", docs).select("doc_id", "head", "next")


@query("SELECT doc_id, text AS payload FROM documents WHERE text <> ''")
def frame_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octet-counted frames written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("payload"))
    return network.frames(docs.select("doc_id", fields.syslog_frame(docs).cast("binary").alias("blob")), "blob").select("doc_id", "payload")


@query(r"SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n')) AS payload FROM documents")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline-terminated messages of a blob."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("blob"))
    return network.lines(docs, "blob").select("doc_id", "payload")


@query("SELECT range AS seq, repeat('a', 100) AS payload FROM range(1000)")
def from_infinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.infinity(spark, 1000).select(F.col(model.SEQ).alias("seq"), "payload")


@query("SELECT range AS seq, 'tidelog://timer' AS origin, 'tidelog' AS program FROM range(60)")
def from_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.timer(spark, 60).select(F.col(model.SEQ).alias("seq"), F.col("from").alias("origin"), "program")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS same FROM customer")
def case_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case that compares two templates, both of fields."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("a"), F.lit("BUILDING").alias("b"))
    text = route.switch(c, parse_template("$a"), [route.Case(parse_template("$b"), lambda d, g: model.write(d, {"same": F.lit("yes")}, g))])
    return text.select("c_custkey", F.col("same").isNotNull().alias("same"))


@query("SELECT l_orderkey, l_linenumber, 'part ' || l_partkey || ' x' || CAST(l_quantity AS INTEGER) || CASE l_returnflag WHEN 'R' THEN ' returned' WHEN 'A' THEN ' accepted' ELSE '' END AS line FROM lineitem")
def lineitem_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("int").cast("string").alias("n"), F.col("l_returnflag").alias("flag"))
    return transform("set $line 'part $part x$n'; switch $flag { case R {set $line '$line returned'} case A {set $line '$line accepted'} }", li).select("l_orderkey", "l_linenumber", "line")
