import socket
import time
import urllib.request

import pytest

from tidelog.plans.language import ConfigError
from tidelog.streaming import buffer, engine, sinks


def free_port(kind=socket.SOCK_STREAM):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def wait(test, seconds=40):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.1)
    return False


@pytest.fixture
def running(spark, tmp_path):
    held = []

    def start(text):
        held.append(engine.Engine(spark, text, str(tmp_path / f"engine{len(held)}")).start())
        return held[-1]

    yield start
    for e in held:
        e.stop()


def test_udp_tcp_and_frames_to_mock(running):
    udp, tcp, framed = free_port(socket.SOCK_DGRAM), free_port(), free_port()
    e = running(f"flow {{ from udp 127.0.0.1:{udp}; parse syslog; set $payload '$program: $payload'; to mock one; }} join {{from tcp 127.0.0.1:{tcp}}} join {{from tcp 127.0.0.1:{framed} as syslog-frame}} to mock two;")
    counts = e.metrics.holder("test")
    sinks.MemorySink.rows("one").clear()
    sinks.MemorySink.rows("two").clear()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto("<14>Mar  7 08:15:02 prog: grüße".encode(), ("127.0.0.1", udp))
        s.sendto(b"not syslog", ("127.0.0.1", udp))
    for port, data in ((tcp, b"line one\r\nline two\nrest"), (framed, b"5 hello3 abc")):
        with socket.create_connection(("127.0.0.1", port)) as s:
            s.sendall(data)
    assert wait(lambda: sinks.MemorySink.rows("one") and len(sinks.MemorySink.rows("two")) >= 5)
    assert sinks.MemorySink.rows("one") == ["prog: grüße"]
    assert sorted(sinks.MemorySink.rows("two")) == ["abc", "hello", "line one", "line two", "rest"]
    assert wait(lambda: counts.read(False)["unparsedDropped"] == 1)
    seen = counts.read(False)
    assert (seen["fromUdpMessages"], seen["fromTcpMessages"], seen["fromTcpNewConnections"], seen["messagesReceived"]) == (2, 5, 2, 7)


def test_file_sink_metrics_and_reload(running, tmp_path):
    e = running(f"prometheus_metrics_http_address 127.0.0.1:{(port := free_port())}; from mock a; tee {{set $payload dump; to mock dumps}} to file '{tmp_path}/out/$program.log';")
    e.metrics.holder("test")
    a = e.listeners.memory("a")
    a.receive(b"first", "mock://", program="x")
    a.receive(b"second\n", "mock://", program="x")
    a.receive(b"other", "mock://", program="y")
    read = lambda n: (tmp_path / "out" / f"{n}.log").read_bytes() if (tmp_path / "out" / f"{n}.log").exists() else b""
    assert wait(lambda: read("x") == b"first\nsecond\n" and read("y") == b"other\n")
    assert wait(lambda: e.metrics.holder("test").read(False)["toFileMessages"] == 3)
    text = urllib.request.urlopen(f"http://127.0.0.1:{port}/any").read().decode()
    assert "tidelog_to_file_messages" in text
    assert not e.reload("from nowhere") and e.queries[0].isActive
    assert e.reload(f"from mock a; set $payload 'new $payload'; to file '{tmp_path}/out/z.log';")
    a.receive(b"third", "mock://")
    assert wait(lambda: b"new third\n" in read("z"))


def test_socket_and_shell_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "one"), (2, "two\n")], "_seq long, payload string")
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        assert sinks.to_udp(df, s.getsockname()) == 2
        assert {s.recv(100), s.recv(100)} == {b"one", b"two\n"}
    with socket.create_server(("127.0.0.1", 0)) as server:
        server.settimeout(10)
        assert sinks.to_tcp(df, server.getsockname(), give_up=5) == 2
        got, data = server.accept()[0], b""
        while part := got.recv(100):
            data += part
        assert data == b"one\ntwo\n"
    command = f"tee {tmp_path}/shell.txt"
    assert sinks.to_shell(df, command) == 2
    sinks.ShellSink.of(command).close()
    assert (tmp_path / "shell.txt").read_text() == "one\ntwo\n"


def test_stdout(spark, capsys):
    df = spark.createDataFrame([(2, "b"), (1, "a\nc")], "_seq long, payload string")
    sinks.to_stdout(df)
    sinks.to_stdout(df, prefix="> ")
    assert capsys.readouterr().out == "a\nc\nb\n> a\n> c\n> b\n"


def test_dump_sink(spark, capsys):
    from tidelog.functions.templates import parse_template
    from tidelog.plans.commands import To

    df = spark.createDataFrame([(4, "x", "h1")], "_seq long, a string, host string")
    engine.deliver(To("dump", template=parse_template("$host> ")), df)
    engine.deliver(To("dump"), df)
    assert capsys.readouterr().out == "h1> #4\nh1> $a=x\nh1> $host=h1\n#4\n$a=x\n$host=h1\n"


def test_streams_of_a_program():
    from tidelog.plans.commands import read_program

    p = read_program("flow {from timer; to stdout} from udp 100; join {from tcp 101; flow {from udp 102}}")
    assert [[s.kind for s in p.sources(b)] for b in engine.streams(p)] == [["timer"], ["udp"], ["udp", "tcp"]]


def test_validate():
    assert engine.validate("from timer; to stdout") is None
    assert engine.validate("from timer; to nowhere").startswith("`to` knows no such sink")
    with pytest.raises(ConfigError):
        engine.Engine(None, "nonsense") if False else __import__("tidelog.plans.commands", fromlist=["x"]).read_program("nonsense")


def test_a_chunk_that_fits_no_buffer_is_lost_alone():
    queue = buffer.Queue(buffer.Buffer(200, "off"), 3)
    for i in range(12):
        queue.put({"payload": (b"x" * 300 if 3 <= i < 6 else b"y")})
    got = []
    while part := queue.take():
        got += part
    assert len(got) == 9 and queue.overflow == 3 and all(m["payload"] == b"y" for m in got)


def test_a_replayed_batch_is_in_a_file_once(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "logs" / "a.log"
    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "_seq long, payload string")
    put = lambda df, *writer, file=path: sinks.to_file(df, F.lit(str(file)), writer=writer or None)
    put(frame("a", "b"), "s", "0", 1)
    put(frame("c"), "s", "1", 1)  # two sinks of one stream
    assert put(frame("a", "b"), "s", "0", 1) == 2
    put(frame("c"), "s", "1", 1)
    assert path.read_text() == "a\nb\nc\n"
    put(frame("d"), "s", "0", 2)
    put(frame("d"), "s", "0", 2)
    assert path.read_text() == "a\nb\nc\nd\n"
    put(frame("e"), "other", "0", 2)  # what another stream has appended stays, so d comes again
    put(frame("d"), "s", "0", 2)
    assert path.read_text() == "a\nb\nc\nd\ne\nd\n"
    put(frame("f"), "s", "0", 3)
    path.rename(tmp_path / "old.log")  # rotated between a batch and its replay
    put(frame("f"), "s", "0", 3)
    assert path.read_text() == "f\n"
    put(frame("g"))
    put(frame("g"))
    assert path.read_text() == "f\ng\ng\n"


def test_files_of_a_stream_have_journals(running, tmp_path):
    e = running(f"from mock j; to file '{tmp_path}/j.log'; to file '{tmp_path}/j.log';")
    e.listeners.memory("j").receive(b"once", "mock://")
    assert wait(lambda: (tmp_path / "j.log").exists() and (tmp_path / "j.log").read_text() == "once\nonce\n")
    assert e.queries[0].id in (tmp_path / ".j.log.journal").read_text()


@pytest.mark.parametrize("limit", [0, 5, 64, 1000, 10**9])
def test_survivors_over_ranges(spark, monkeypatch, limit):
    from pyspark.sql import functions as F

    monkeypatch.setattr(buffer, "RANGE", 4)
    sizes = [(i, (i * 7) % 11) for i in range(100)]
    df = spark.createDataFrame(sizes, "i long, n long")
    got = sorted(r.i for r in buffer.survivors(df, F.col("i"), F.col("n"), limit, 3).collect())
    held, kept = 0, {0, 33}
    for chunk in range(32, 0, -1):
        held += sum(n for i, n in sizes if i // 3 == chunk)
        if held <= limit:
            kept.add(chunk)
    assert got == [i for i, _ in sizes if i // 3 in kept]
