import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import fields, packs
from tidelog.functions.regexps import Regexp
from tidelog.operators import parse
from tidelog.plans.compiler import transform
from tidelog.sources import network, tables
from tidelog.streaming import buffer, engine, metrics


@pytest.mark.parametrize("path,name", [
    ("", "noname"), ("///", "noname"), ("logs/..", "noname"), ("logs/.", "noname"), ("home:~", "noname"), ("x;|", "noname"),
    ("/var/log/shop/access.log", "access.log"), ("shop\\2024:errors;today", "today"), ("/srv/журнал/день.txt//", "день.txt"), ("~backup.tar", "backup.tar"), ("...", "..."), ("a b/c d", "c d"),
])
def test_basename(send, path, name):
    assert send("set $b basename $path", path=path)["b"] == name


@pytest.mark.parametrize("fmt,at,out", [
    ("date as time", "2018-06-12T11:26:12+01:00", "11:26:12"), ("date as date", "2018-06-12T11:26:12+01:00", "2018-06-12"), ("date as datetime", "2018-06-12T11:26:12+01:00", "2018-06-12T11:26:12+01:00"),
    ("date as datetime", "2018-06-12T11:26:12Z", "2018-06-12T11:26:12+00:00"), ("date as unixtime-seconds", "2018-06-12T11:26:12+01:00", "1528799172"),
    ("date as unixtime-milliseconds", "2018-06-12T11:26:12+01:00", "1528799172000"), ("date as unixtime-microseconds", "2018-06-12T11:26:12+01:00", "1528799172000000"),
    ("date as unixtime-nanoseconds", "2018-06-12T11:26:12+01:00", "1528799172000000000"), ("time", "2018-06-12T11:26:12+01:00", "11:26:12"), ("date", "2018-06-12T11:26:12-03:30", "2018-06-12"),
    ("date as 'yyyy/MM/dd HH:mm XXX'", "2018-06-12T11:26:12Z", "2018/06/12 11:26 Z"), ("date as 'HH xxx Z X'", "2018-06-12T11:26:12+05:00", "11 +05:00 +0500 +05"),
    ("date as datetime", "06/Jun/2018:15:19:48 +0300", "2018-06-06T15:19:48+03:00"), ("date", "2018-06-12", "invalid-date"), ("date", "6/Jun/2018:15:19:48 +0300", "invalid-date"), ("date", "", "invalid-date"), ("date", "2018-02-30T00:00:00Z", "invalid-date"),
])
def test_time(send, fmt, at, out):
    assert send(f"set $d {fmt} in $date", date=at)["d"] == out


def test_time_now_in_a_zone(spark):
    df = spark.createDataFrame([("x",)], "payload string")
    out = transform("create_dates_in_timezone Asia/Kolkata; set $d date as datetime;", df, now=F.lit("2020-01-01 00:00:00").cast("timestamp")).first()
    assert out["d"] == "2020-01-01T05:30:00+05:30"


def test_severity_name(send):
    for i, n in enumerate(fields.SEVERITIES):
        assert send("set $n severity-name $s; set $l severity-name $s lowercase", s=str(i)) == {"s": str(i), "n": n, "l": n.lower()}
    assert send("set $n severity-name $s", s="9")["n"] == "9"


@pytest.mark.parametrize("text,fields_in,out", [
    ("set $payload replace ~cat~ '$1'", {"payload": "a cat"}, "a cat"), ("set $payload replace ~cat|dog~ animal", {"payload": "cats and dogs"}, "animals and animals"),
    ("set $payload replace ~(c)at~ '$1ow'", {"payload": "cat"}, "cow"), ("set $payload replace ~CAT~i x", {"payload": "cat"}, "x"), (r"set $payload replace ~\n~ '\\\\n'", {"payload": "a\nb"}, r"a\nb"),
    ("set $payload replace ~cat~ '$animal'", {"payload": "cat", "animal": "dog"}, "dog"), ("set $payload replace ~cat~ '$animal'", {"payload": "cat", "animal": "US$"}, "cat"),
    ("set $payload replace ~^$~ '-'", {"payload": ""}, "-"), ("set $payload replace ~cat~ 'dog' in '{$x}astrophe'", {"x": "cat"}, "dogastrophe"), ("set $payload replace ~(?<n>c)~ '${n}h'", {"payload": "cat"}, "chat"),
])
def test_replace(send, text, fields_in, out):
    assert send(text, **fields_in)["payload"] == out


@pytest.mark.parametrize("line,out", [
    ("<85>Mar 17 08:15:02 web-3 sshd: session closed: root", {"facility": "10", "severity": "5", "host": "web-3", "program": "sshd", "payload": "session closed: root"}),
    ("<0>Mar  7 08:15:02 kernel: up\ndown", {"facility": "0", "severity": "0", "program": "kernel", "payload": "up\ndown"}),
    ("<15>1 2017-03-03T09:26:44+00:00 h p 12 m - text", {"facility": "1", "severity": "7", "date": "2017-03-03T09:26:44+00:00", "host": "h", "program": "p", "pid": "12", "messageId": "m", "payload": "text"}),
    ("<15>1 2017-03-03T09:26:44.999Z h p - - - text", {"facility": "1", "severity": "7", "date": "2017-03-03T09:26:44+00:00", "host": "h", "program": "p", "payload": "text"}),
    ("no syslog", None), ("<15> Mar 17 08:15:02 a: b", None),
])
def test_syslog(send, line, out):
    assert send("parse syslog", payload=line) == out
    if out is None:
        assert send("parse keep-unparsed syslog", payload=line) == {"payload": line}


def test_syslog_keeps_fields_that_the_line_lacks(send):
    got = send("parse syslog", payload="<15>1 2017-03-03T09:26:44Z - - - - - x", host="mine", program="prog", pid="7")
    assert (got["host"], got["program"], got["pid"]) == ("mine", "prog", "7")


def test_syslog_format_and_frame(spark):
    df = spark.createDataFrame([("поехали", "3", "1", "h", "p", "9", "2018-06-12T11:26:12+03:00"), ("x", None, None, None, None, None, "nonsense")], "payload string, facility string, severity string, host string, program string, pid string, date string")
    out = [r[0] for r in df.select(fields.syslog(df, F.lit("2020-01-01").cast("timestamp"), "me")).collect()]
    assert out == ["<25>1 2018-06-12T11:26:12+03:00 h p 9 - - поехали", "<14>1 2020-01-01T00:00:00+00:00 me - - - - x"]
    assert [r[0] for r in df.select(fields.syslog_frame(df)).collect()] == ["14 поехали", "1 x"]


@pytest.mark.parametrize("text,out", [
    ('{"a": "b", "n": 12, "t": true, "z": null, "e": ""}', {"a": "b", "n": "12", "t": "true"}), ('{"payload": "new"}', {"payload": "new"}), ('{"k": "\\u043f\\n"}', {"k": "п\n"}), ("{}", {}),
    ('{"a": ', None), ("[]", None), ('{"a": {"b": 1}}', None), ('{"c": 1, "a": [1]}', None), ("", None), ("12", None),
])
def test_parse_json(spark, text, out):
    df = spark.createDataFrame([(text, "old", "gone")], "payload string, a string, z string")
    rows = parse.json_fields(df).collect()
    if out is None:
        assert rows == []
        return
    got = {k: v for k, v in rows[0].asDict().items() if k != model.REST and v is not None} | dict(rows[0][model.REST] or {})
    want = {"payload": text, "a": "old", "z": "gone"} | out
    for k in ("z", "e"):
        if f'"{k}"' in text:
            want.pop(k, None)
    assert got == want


def test_json_is_one_flat_object(spark):
    deep = '"' + "x\\n" * 20_000 + '"'
    rows = ['{"a": 1} x', '{"a": 01}', '{"a": 1.}', '{"a": nan}', "{'a': 1}", '{"a": 1,}', '{"a" 1}', '{"a": "\\x"}', '{"a":1}{"b":2}', '{"a": [1]}',
            '{"a": %s, "b": -1.0E+5}' % deep, ' { "\\"a\\": 1" : "\\": 2.0,", "b":3.10 } ', '{"b": 0.0, "b": 2.50}']
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    got = [dict(r[model.REST]) for r in parse.json_fields(df).collect()]
    assert [g["b"] for g in got] == ["-1.0E+5", "3.10", "2.50"]
    assert got[0]["a"] == "x\n" * 20_000 and got[1]['"a": 1'] == '": 2.0,'


def test_parsers_run_in_streams(spark, tmp_path):
    lines = ['{"n": 1.10, "t": "x"}', "none", "<15>1 2017-03-03T09:26:44Z h p 7 - - text"]
    spark.createDataFrame([(x,) for x in lines], "payload string").write.parquet(f"{tmp_path}/in")
    for text, want in (("parse json; drop", 0), ("parse json; set $payload '$n'", 1), ("parse syslog; keep $payload $pid", 1), (r"parse ~^(?<first>[a-z]+)$~; set $payload '$first'", 1), ("parse keep-unparsed json", 3)):
        stream = spark.readStream.schema("payload string").parquet(f"{tmp_path}/in")
        name = f"parsed_{abs(hash(text))}"
        query = transform(text, stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert spark.table(name).count() == want


def test_a_later_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, '{"a": 1}')], "n int, payload string").write.parquet(f"{tmp_path}/in")
    plan = transform("parse syslog", spark.read.parquet(f"{tmp_path}/in")).where("n > 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("> 5") > plan.index("Generate")


def test_groups_that_take_no_part(spark):
    df = spark.createDataFrame([("ab", "old"), ("a", "old"), ("xaab", "old")], "payload string, g string")
    out = parse.regexp(df, Regexp("(?<w>a+)(?:(?<g>)b|$)"))
    assert [(r.w, r.g) for r in out.collect()] == [("a", None), ("a", "old"), ("aa", None)]


def test_exact_json_keeps_the_text_of_numbers(spark):
    df = spark.createDataFrame([('{"a": 1.50, "b": 1e3}',), ('{"a": 1} x',)], "payload string")
    assert [dict(r[model.REST]) for r in parse.json_fields(df).collect()] == [{"a": "1.50", "b": "1e3"}]


def test_regexp_groups(send):
    assert send("parse ~(?<kind>access|error)~", payload="an error, no access") == {"payload": "an error, no access", "kind": "error"}
    assert send("parse ~(?<a>x)?(?<b>y)~", payload="y", a="kept") == {"payload": "y", "a": "kept", "b": "y"}
    assert send("parse ~(?<a>x*)(?<b>y)~", payload="y", a="removed") == {"payload": "y", "b": "y"}
    assert send("parse ~nothing~", payload="y") is None
    assert send("parse keep-unparsed ~(?<q>nothing)~", payload="y") == {"payload": "y"}


def test_json_out(spark, send):
    assert send("set $payload json", custom="b", payload="a\nb") == {"custom": "b", "payload": '{"custom":"b","payload":"a\\nb"}'}
    assert send("set $payload json $payload $none $custom", custom="кот 😀", payload='q"')["payload"] == '{"payload":"q\\"","none":"","custom":"кот 😀"}'
    assert send("set $payload json", payload=" ")["payload"] == '{"payload":"\\u2028"}'
    assert json.loads(send("parse json; set $payload json", payload='{"z": 1, "a": "x"}')["payload"]) == {"a": "x", "z": "1", "payload": '{"z": 1, "a": "x"}'}


def test_keep_drop_unset(send):
    assert send("keep $kind $payload $nothing", removed="1", kind="2", payload="3") == {"kind": "2", "payload": "3"}
    assert send("parse json; keep $a", payload='{"a": "1", "b": "2"}') == {"a": "1"}
    assert send("drop", a="1") is None
    assert send("set $a ''", a="1", b="2") == {"b": "2"}


SWITCH = "switch $animal { case ~^(?<feline>cat|lion)~ {set $kind '$feline!'} case '$pet' {set $kind pet} %s }"


@pytest.mark.parametrize("animal,kind,default", [("lion king", "lion!", ""), ("dog", "pet", ""), ("cow", None, ""), ("cow", "other", "default {set $kind other}"), ("lion", "lion!", "default {drop}"), ("cow", "DROP", "default {drop}")])
def test_switch(send, animal, kind, default):
    got = send(SWITCH % default, animal=animal, pet="dog")
    assert (got or {"kind": "DROP"}).get("kind") == kind


def test_switch_nested_and_fields_of_a_failed_case_stay(send):
    text = "switch $a { case ~(?<f>x)y~ {} case ~x~ { switch $b { case 1 {set $r one} default {set $r more; parse keep-unparsed json} } } }"
    assert send(text, a="xz", b="1", f="old") == {"a": "xz", "b": "1", "f": "old", "r": "one"}
    assert send(text, a="xz", b="2")["r"] == "more"


def test_switch_with_a_filtering_parser(spark):
    df = spark.createDataFrame([("j", '{"k": "1"}'), ("j", "bad"), ("s", "<14>Mar 17 08:15:02 p: hi"), ("o", "as is")], "f string, payload string")
    out = transform("switch $f { case j {parse json} case s {parse syslog} }", df, json_keys=["k"])
    assert sorted((r.f, r.payload, r.k, r.program) for r in out.collect()) == [("j", '{"k": "1"}', "1", None), ("o", "as is", None, None), ("s", "hi", None, "p")]


def test_switch_that_splits(spark):
    df = spark.createDataFrame([("m", "1"), ("x", "2")], "a string, b string")
    out = transform("switch $a { case m {parse each-field-as-message} }", df)
    assert sorted((r.key, r.value, r.a) for r in out.collect() if r.key) == [("a", "m", None), ("b", "1", None)]
    assert [(r.a, r.b) for r in out.collect() if not r.key] == [("x", "2")]


def test_routing(send, spark):
    for kind in ("flow", "tee", "join"):
        assert send(f"set $path '$path, before'; {kind} {{set $path '$path, inside'}} set $path '$path, after'", path="start")["path"] == "start, before, after"
    df = spark.createDataFrame([("start",)], "path string")
    out, sinks = engine.run_batch(spark, "tee {set $path '$path, inside'; to mock x} join {from mock; set $path other} set $path '$path, end'", {"mock": df}, df)
    assert sorted(r.path for r in out.collect()) == ["other, end", "start, end"]
    assert [(s.kind, s.name, [r.path for r in d.collect()]) for s, d in sinks] == [("mock", "x", ["start, inside"])]


def test_from_within_a_branch_passes_the_conditions(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    more = spark.createDataFrame([("zzz",)], "k string")
    out = transform("switch $k { case a { from mock; set $seen yes } }", df, sources=lambda s: more)
    assert sorted((r.k, r.seen) for r in out.collect()) == [("a", "yes"), ("b", None), ("zzz", "yes")]


def test_dump(spark):
    df = spark.createDataFrame([(7, "x", None, "w")], f"{model.SEQ} long, b string, c string, a string")
    assert df.select(fields.dump(df)).first()[0] == "#7\n$a=w\n$b=x"


def test_binary_is_kept_until_text_is_made(spark):
    df = spark.createDataFrame([(bytes.fromhex("61C32862"),)], "raw binary").select(F.col("raw").cast("string").alias("payload"))
    out = transform("set $same $payload; set $text '{$payload}-dog'; set $frame syslog-frame", df).select(*[F.hex(F.col(c).cast("binary")) for c in ("same", "text", "frame")]).first()
    assert out[0] == "61C32862"
    assert bytes.fromhex(out[1]).decode() == "a�(b-dog"
    assert bytes.fromhex(out[2]) == b"4 a\xc3(b"


def test_env_and_host(send, monkeypatch):
    monkeypatch.setenv("TIDE_TEST", "value")
    got = send("set $e env TIDE_TEST; set $n env TIDE_NONE; set $h host", a="1")
    assert got["e"] == "value" and "n" not in got and got["h"] == fields.host()


# --- packs ---------------------------------------------------------------------------------


def test_pack_bytes():
    assert packs.encode([{"payload": b"cat"}]) == b"\x01\x07payload\x01\x03cat"
    assert packs.encode([{"sound": b"meow", "claws": b"4"}, {"sound": b"woof", "tail": b"1"}]) == b"\x03\x05claws\x05sound\x04tail\x02\x014\x04meow\x00\x00\x04woof\x011"
    assert packs.decode(packs.encode([{"a": b"1"}, {"b": b"2"}]) + b"tail") == [{"a": b"1"}, {"b": b"2"}]


@pytest.mark.parametrize("n,data", [(0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (129, "8101"), (255, "ff01"), (256, "8002"), (300, "ac02"), (16383, "ff7f"), (16384, "808001"), (1 << 40, None)])
def test_numbers(n, data):
    assert data is None or packs.write_num(n).hex() == data
    assert packs.read_num(packs.write_num(n), 0) == (n, len(packs.write_num(n)))


def test_all_small_numbers_round_trip():
    assert all(packs.read_num(packs.write_num(n), 0)[0] == n for n in range(33_000))


def test_pack_round_trip_and_bad_packs(spark):
    df = spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string")
    rows = parse.pack(df.select(packs.pack(df).alias("payload")), keys=["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in rows) == [("1", "x"), ("2", None)]
    bad = spark.createDataFrame([("\x05abc", "y")], "payload string, other string")
    assert parse.pack(bad).count() == 0
    assert [r.other for r in parse.pack(bad, keep_unparsed=True).collect()] == ["y"]


# --- each field, frames, sources, buffer, metrics -----------------------------------------


def test_each_field(spark):
    df = spark.createDataFrame([("meow", None)], "cat string, dog string")
    assert [tuple(r) for r in parse.each_field(df).collect()] == [("cat", "meow")]
    assert parse.each_field(df.select(F.lit(None).cast("string").alias("x"))).count() == 0


def test_framing():
    assert network.split_frames(b"3 abc12 hello world!0 x4 ab") == ([b"abc", b"hello world!"], b"x4 ab")
    assert network.split_frames(b"zz2 ab") == ([b"ab"], b"")
    assert network.split_frames(b"5 abc") == ([], b"5 abc")
    assert network.split_lines(b"a\r\nb\n\nc") == ([b"a", b"b", b""], b"c")


def _blobs():
    r = random.Random(7)
    frame = lambda d: str(len(d)).encode() + b" " + d
    fixed = [b"", b" ", b"0 ", b"1 ", b"1 a", b"zz2 ab", b"3 abc12 hello world!0 x4 ab", b"5 abc", b"\n2 ab", b"2 \xc3\xa9 2 \xff\x00", b"7" * 33, b"7" * 64 + b"x3 abc", b"0" * 100 + b"5 hello1 a"]
    fixed += [b"x" * n + tail + b"2 ab3 a" for n in (30, 31, 32, 33, 64, 500) for tail in (b"", b"1", b"\xff")]
    fixed.append(b"".join(frame(b"%d" % i) for i in range(3000)))
    noise = [bytes(r.choice(b"00123 ax\n\xff") for _ in range(r.randrange(200))) for _ in range(150)]
    mixed = [b"".join(r.choice([b"", b"junk", b"0" * 40, b"9" * 50 + b"z"]) + frame(bytes(r.randrange(256) for _ in range(r.choice([0, 1, 40, 300])))) for _ in range(r.randrange(60)))[: r.choice([-7, -1, None])] for _ in range(150)]
    return fixed + noise + mixed


def test_frames_of_blobs(spark):
    blobs = [*_blobs(), None]
    df = spark.createDataFrame(list(enumerate(blobs)), "id long, blob binary")
    got = network.frames(df, "blob").select("id", model.SEQ, F.col("payload").cast("binary").alias("payload")).collect()
    wanted = [(i, at, f) for i, b in enumerate(blobs) if b is not None for at, f in enumerate(network.split_frames(b)[0])]
    assert sorted((r["id"], r[model.SEQ], bytes(r["payload"])) for r in got) == wanted


def test_frames_take_no_python_on_executors(spark):
    """A worker's memory grew with its batches of blobs and frames."""
    blob = F.concat(F.repeat(F.lit("0"), F.lit(5000)), F.lit("3 ab"), F.col("id").cast("string")).cast("binary")
    found = network.frames(spark.range(3).select("id", blob.alias("blob")), "blob")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("aggregate(") == 2  # two levels, once
    assert sorted(r["payload"] for r in found.collect()) == ["ab0", "ab1", "ab2"]


def test_tables(spark):
    rows = tables.timer(spark, 3, 30).collect()
    assert [r["program"] for r in rows] == ["tidelog"] * 3 and all(len(r["payload"].split()) >= 5 for r in rows)
    assert tables.infinity(spark, 5, 7).select("payload").distinct().collect()[0][0] == "a" * 7


def test_queue_drops_the_oldest_chunks():
    m = metrics.Metrics()
    h = m.holder("x")
    q = buffer.Queue(buffer.Buffer(1000, "off", m), 5)
    for i in range(100):
        q.put({"v": f"{i:099d}".encode()})
    left = []
    while got := q.take():
        left += [int(x["v"]) for x in got]
    assert left[:5] == [0, 1, 2, 3, 4] and left[-5:] == [95, 96, 97, 98, 99]
    assert left == sorted(left) and q.overflow == 100 - len(left) == h.read(False)["queueOverflows"]
    assert len(left) == 5 + 5 + 5  # one packed chunk of 5 messages has over 500 bytes


def test_queue_in_order_and_compressed():
    q = buffer.Queue(buffer.Buffer(10_000), 3)
    for i in range(20):
        q.put({"v": b"a" * 50 + str(i).encode()})
    assert q.buffer.used < 20 * 50
    out = []
    while got := q.take():
        out += [x["v"][50:].decode() for x in got]
    assert out == [str(i) for i in range(20)] and q.buffer.used == 0


def test_a_chunk_larger_than_the_buffer():
    q = buffer.Queue(buffer.Buffer(10, "off"), 1)
    for _ in range(3):
        q.put({"v": b"x" * 50})
    assert (len(q.take()), len(q.take()), q.take(), q.overflow) == (1, 1, [], 1)  # the middle one is lost



def test_survivors(spark):
    df = spark.range(100).withColumn("v", F.lit("x" * 99))
    left = [r.id for r in buffer.survivors(df, F.col("id"), F.lit(99), 1000, 5).orderBy("id").collect()]
    assert left == [*range(5), *range(85, 100)]


def test_metrics():
    assert len(metrics.NAMES) == 48
    m = metrics.Metrics()
    a, b = m.holder("a"), m.holder("b")
    m.transfer("fromUdp", 2, 30, 50)
    assert a.read(True)["fromUdpTotalBytes"] == 50 and a.read(True)["fromUdpTotalBytes"] == 0 and b.read(False)["messagesReceived"] == 2
    assert metrics.summary({"heapMaxBytes": 3 << 19, "uptimeSeconds": 90061, "messagesSent": 4}) == "heap-max 1.5M messages-sent 4 uptime 1d1h1m1s"
    assert metrics.human_bytes(1023) == "1023" and metrics.human_bytes(200 << 20) == "200M"
    text = metrics.prometheus(m.snapshot("b", False))
    assert "tidelog_from_udp_total_bytes 50" in text and "from_udp_max_bytes" not in text and "tidelog_heap_max_bytes 0" in text


def test_parse_stats(spark):
    df = spark.createDataFrame([("h1", "two words")], "host string, note string")
    out = parse.stats(df, {"messagesSent": 3, "uptimeSeconds": 61}, now_nanos=5).first()
    assert out["influxLineProtocolPayload"] == "tidelog,host=h1 messagesSent=3,uptimeSeconds=61 5"
    assert out["payload"] == "messages-sent 3 uptime 1m1s" and out["messagesSent"] == "3"


def test_explain_has_one_narrow_stage(spark):
    df = spark.createDataFrame([("a",)], "payload string")
    text = engine.explain(spark, "switch $payload { case a {set $b c} default {drop} }", df)
    assert text.startswith("switch $payload {") and "Exchange" not in text


@pytest.mark.parametrize("pattern", ["uuuu-DDD", "uu", "uuuuuu", "n|nnnn", "N", "NNNNNNNNNNNNNNNNN", "A", "AAAAAAAAA", "g", "ggggggg", "VV", "z", "zzzz", "X|XX|XXX|x|xx|xxx", "Z|ZZZZ|ZZZZZ|OOOO", "'it''s' u, VV'V'"])
def test_date_patterns_as_java_formats_them(spark, pattern):
    dates = ["2024-02-29T23:05:09+05:30", "1999-12-31T00:00:00Z", "1700-03-01T12:00:00-08:00", "0099-07-04T01:02:03+00:00"]
    java = spark._jvm.java.time
    wanted = [java.ZonedDateTime.parse(d).format(java.format.DateTimeFormatter.ofPattern(pattern, spark._jvm.java.util.Locale.US)) for d in dates]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    assert [r[0] for r in df.select(fields.time(pattern, F.col("d"))).collect()] == wanted


def test_zone_of_the_present_time(spark):
    at = F.lit("2024-07-01 12:00:00").cast("timestamp")
    assert spark.range(1).select(fields.time("HH:mm VV", now=at, zone="Europe/Berlin")).first()[0] == "14:00 Europe/Berlin"
    with pytest.raises(fields.PatternError):
        fields.time("HH z", now=at)
