"""Network receivers. A receiver runs on the driver, queues what arrives in a bounded
buffer, and spools it into a directory of JSON files, which Structured Streaming reads:
a socket can't be read again, the spool can, so a restarted query loses nothing that had
been spooled. Listeners are shared by address.
"""

from __future__ import annotations

import base64
import json
import logging
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..streaming.buffer import Buffer, Queue
from ..streaming.metrics import Metrics

MAX_DATAGRAM = 65507
#: Bytes that are searched at once for the space after a frame's length, and most steps of a block (see ``_frames_of``).
HEADER, BLOCK = 32, 1024
SCHEMA = f"{model.SEQ} long, date string, `from` string, payload binary, program string, severity string"


class FramingConflict(ValueError):
    """One address can't serve two framings."""


def split_lines(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Complete lines without their LF or CRLF, and the rest."""
    *lines, rest = buffer.split(b"\n")
    return [x.removesuffix(b"\r") for x in lines], rest


def split_frames(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Complete octet-counted frames ``LENGTH SP DATA``, and the rest. Anything but a digit
    before the space starts the length anew; a missing or zero length is skipped."""
    frames, at = [], 0
    while True:
        start, i, length = at, at, ""
        while i < len(buffer) and buffer[i : i + 1] != b" ":
            c = chr(buffer[i])
            length = length + c if c.isdigit() and c.isascii() else ""
            i += 1
        if i >= len(buffer):
            return frames, buffer[start:]
        n = int(length or 0)
        if i + 1 + n > len(buffer):
            return frames, buffer[start:]
        if n:
            frames.append(buffer[i + 1 : i + 1 + n])
        at = i + 1 + n


class Spool:
    """Writes queued messages into files that appear whole, one for each chunk."""

    def __init__(self, path: str, queue: Queue, pause: float = 0.05):
        self.path, self.queue, self.pause = path, queue, pause
        os.makedirs(path, exist_ok=True)
        # numbers go on where an earlier spool ended, as long as it wrote less than a message a microsecond
        self._n, self._stop = time.time_ns() // 1000, threading.Event()
        self.paused = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._stop.is_set():
            if self.paused.is_set() or not self.flush():
                self._stop.wait(self.pause)
        while self.flush():
            pass

    def flush(self) -> int:
        messages = self.queue.take()
        if messages:
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:6]}.json"
            with open(f"{self.path}/.{name}", "w") as out:
                for m in messages:
                    self._n += 1
                    row = {model.SEQ: self._n} | {k: base64.b64encode(v).decode() if k == "payload" else v.decode() for k, v in m.items()}
                    out.write(json.dumps(row) + "\n")
            os.rename(f"{self.path}/.{name}", f"{self.path}/{name}")
        return len(messages)

    def stop(self) -> None:
        self._stop.set()
        self._thread.join(5)


class Receiver:
    """Base: stamps messages and queues them."""

    transport = ""

    def __init__(self, path: str, buffer: Buffer, metrics: Metrics | None = None, chunk: int = 500, zone: str = "UTC"):
        self.queue, self.metrics, self.zone = Queue(buffer, chunk), metrics, ZoneInfo(zone)
        self.spool = Spool(path, self.queue)
        self._stop = threading.Event()

    def receive(self, payload: bytes, source: str, **more: str) -> None:
        date = datetime.now(self.zone).isoformat(timespec="seconds")
        if self.metrics and self.transport:
            self.metrics.transfer(self.transport, 1, len(payload), len(payload))
        self.queue.put({"date": date.encode(), "from": source.encode(), "payload": payload} | {k: v.encode() for k, v in more.items()})

    def stop(self) -> None:
        self._stop.set()
        self.spool.stop()


class UdpReceiver(Receiver):
    transport = "fromUdp"

    def __init__(self, address: tuple[str, int], *args, **kw):
        self._socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self._socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 10 * MAX_DATAGRAM)
        self._socket.bind(address)
        self._socket.settimeout(0.1)
        self.port = self._socket.getsockname()[1]
        super().__init__(*args, **kw)
        threading.Thread(target=self._listen, daemon=True).start()

    def _listen(self) -> None:
        while not self._stop.is_set():
            try:
                data, (host, port) = self._socket.recvfrom(MAX_DATAGRAM)
            except TimeoutError:
                continue
            except OSError:
                return
            self.receive(data, f"udp://{host}:{port}")

    def stop(self) -> None:
        super().stop()
        self._socket.close()


class TcpReceiver(Receiver):
    """A server; ``framing``: 'line' or 'octet'."""

    transport = "fromTcp"

    def __init__(self, address: tuple[str, int], framing: str, *args, **kw):
        self.framing = framing
        self._socket = socket.create_server(address)
        self._socket.settimeout(0.1)
        self.port = self._socket.getsockname()[1]
        super().__init__(*args, **kw)
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while not self._stop.is_set():
            try:
                client, (host, port) = self._socket.accept()
            except TimeoutError:
                continue
            except OSError:
                return
            if self.metrics:
                self.metrics.add("fromTcpNewConnections")
            threading.Thread(target=self._serve, args=(client, f"tcp://{host}:{port}"), daemon=True).start()

    def _serve(self, client: socket.socket, source: str) -> None:
        split = split_lines if self.framing == "line" else split_frames
        rest = b""
        with client:
            client.settimeout(0.2)
            while not self._stop.is_set():
                try:
                    data = client.recv(1 << 16)
                except TimeoutError:
                    continue
                except OSError:
                    break
                if not data:
                    break
                found, rest = split(rest + data)
                for payload in found:
                    self.receive(payload, source)
        if rest and self.framing == "line":  # a line that the end of the connection ends
            self.receive(rest, source)

    def stop(self) -> None:
        super().stop()
        self._socket.close()


class LogReceiver(Receiver, logging.Handler):
    """The engine's own log records as messages."""

    #: Python's levels to syslog severities.
    LEVELS = ((logging.CRITICAL, 2), (logging.ERROR, 3), (logging.WARNING, 4), (logging.INFO, 6), (0, 7))

    def __init__(self, logger: logging.Logger, *args, **kw):
        logging.Handler.__init__(self)
        Receiver.__init__(self, *args, **kw)
        self._logger = logger
        logger.addHandler(self)

    def emit(self, record: logging.LogRecord) -> None:
        severity = next(s for level, s in self.LEVELS if record.levelno >= level)
        self.receive(record.getMessage().encode(), "tidelog://internal-log", program="tidelog", severity=str(severity))

    def stop(self) -> None:
        self._logger.removeHandler(self)
        Receiver.stop(self)


class MemoryReceiver(Receiver):
    """Messages that the program itself puts in: for tests."""

    def send(self, payload: str | bytes) -> None:
        self.receive(payload.encode() if isinstance(payload, str) else payload, "mock://")


class Listeners:
    """Receivers by address; one address is one listener, whoever asks for it."""

    def __init__(self, root: str, buffer: Buffer, metrics: Metrics | None = None, chunk: int = 500, zone: str = "UTC"):
        self.root, self._args = root, {"buffer": buffer, "metrics": metrics, "chunk": chunk, "zone": zone}
        self._held: dict[tuple, Receiver] = {}

    def _get(self, key: tuple, make) -> Receiver:
        if key not in self._held:
            self._held[key] = make(str(Path(self.root, "-".join(map(str, key)).replace("/", "_"))))
        return self._held[key]

    def udp(self, address: tuple[str, int]) -> Receiver:
        return self._get(("udp", *address), lambda p: UdpReceiver(address, p, **self._args))

    def tcp(self, address: tuple[str, int], framing: str = "line") -> Receiver:
        held = self._get(("tcp", *address), lambda p: TcpReceiver(address, framing, p, **self._args))
        if held.framing != framing:
            raise FramingConflict(f"{address[0]}:{address[1]} is read as lines already, or as syslog-frame")
        return held

    def log(self) -> Receiver:
        return self._get(("log",), lambda p: LogReceiver(logging.getLogger("tidelog"), p, **self._args))

    def memory(self, name: str = "default") -> MemoryReceiver:
        return self._get(("mock", name), lambda p: MemoryReceiver(p, **self._args))

    def drop_unused(self, used: set[tuple]) -> None:
        for key in [k for k in self._held if k not in used]:
            self._held.pop(key).stop()

    def stop(self) -> None:
        self.drop_unused(set())


def spooled(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """The spool as a stream (or a batch) of messages."""
    # a file goes once the batch that read it is committed
    reader = spark.readStream.option("cleanSource", "delete") if stream else spark.read
    return reader.schema(SCHEMA).json(path).withColumn("payload", F.col("payload").cast("string"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once (and, if binary, not copied at each use)."""
    return F.transform(F.array(value), then)[0]


def _frames_of(blob: Column) -> Column:
    """array<binary> of the complete frames of a blob, as ``split_frames`` finds them. A step reads
    up to the space after a length, or ``HEADER`` bytes without one: a byte at least. The places
    of frames are binary (ten digits each for start and length), as arrays in an aggregate's state
    are copied at each step; steps go in blocks, as adding to a binary copies that, too."""
    state = lambda at, digits, found: F.struct(at.cast("long").alias("at"), digits.alias("digits"), found.alias("found"))
    blank, none = F.lit(""), F.lit("").cast("binary")

    def step(b: Column, s: Column) -> Column:
        def after(head: Column, word: Column, n: Column) -> Column:
            start, size = s["at"] + F.length(word) + 1, F.when(n == "", F.lit(0)).otherwise(n.cast("long"))
            place = F.concat(F.lpad(start.cast("string"), 10, "0"), F.lpad(size.cast("string"), 10, "0")).cast("binary")
            spaced = F.length(word) < F.length(head)
            more = F.when(~spaced & (F.length(head) == HEADER), state(s["at"] + HEADER, n, s["found"]))
            more = more.when(spaced & (start + size <= F.octet_length(b)), state(start + size, blank, F.when(size > 0, F.concat(s["found"], place)).otherwise(s["found"])))
            return more.otherwise(state(F.octet_length(b), blank, s["found"]))

        def length(word: Column) -> Column:
            digits = F.regexp_extract(word, r"[0-9]*\z", 0)
            joined = F.when(F.length(digits) == F.length(word), F.concat(s["digits"], digits)).otherwise(digits)
            # twelve digits without leading zeros are more bytes than a blob has, whatever follows
            return F.substring(F.regexp_replace(joined, "^0+", ""), 1, 12)

        head = F.decode(F.substring(b, s["at"].cast("int") + 1, F.lit(HEADER)), "ISO-8859-1")
        return _let(head, lambda h: _let(F.regexp_extract(h, "^[^ ]*", 0), lambda w: _let(length(w), lambda n: after(h, w, n))))

    def until_read(b: Column, n: Column, begin: Column, one: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), begin, lambda s, _: F.when(s["at"] >= F.octet_length(b), s).otherwise(one(s)))

    def block(b: Column, s: Column, steps: Column) -> Column:
        joined = lambda t: state(t["at"], t["digits"], F.when(t["found"] == none, s["found"]).otherwise(F.concat(s["found"], t["found"])))
        return _let(until_read(b, steps, state(s["at"], s["digits"], none), lambda t: step(b, t)), joined)

    def cut(b: Column, found: Column) -> Column:
        number = lambda i, at: F.substring(found, i * 20 + at, F.lit(10)).cast("string").cast("int")
        cells = F.transform(F.sequence(F.lit(0), (F.octet_length(found) / 20).cast("int") - 1), lambda i: F.substring(b, number(i, 1) + 1, number(i, 11)))
        return F.when(found != none, cells)

    def whole(b: Column) -> Column:
        steps = F.least(F.lit(BLOCK), F.ceil(F.sqrt(F.octet_length(b))).cast("int"))
        blocks = F.ceil(F.octet_length(b) / F.greatest(F.lit(1), steps)).cast("int")
        return _let(until_read(b, blocks, state(F.lit(0), blank, none), lambda s: block(b, s, steps))["found"], lambda found: cut(b, found))

    return _let(blob, whole)


def frames(df: DataFrame, column: str) -> DataFrame:
    """Batch replay of octet-counted frames: one message for each frame of a binary blob."""
    rest = [c for c in df.columns if c != column]
    cells = df.select(*rest, _frames_of(F.col(column).cast("binary")).alias("_frames"))
    # an inner Generate would have a filter inferred, with all of the expression in it twice more
    found = cells.select(*rest, F.posexplode_outer("_frames").alias("_at", "_frame")).where("_at is not null")
    return found.select(*rest, F.col("_at").cast("long").alias(model.SEQ), F.col("_frame").cast("string").alias("payload"))


def lines(df: DataFrame, column: str) -> DataFrame:
    """Batch replay of newline-terminated text: one message for each line of a blob."""
    text = F.regexp_replace(F.col(column).cast("string"), r"\r?\n\z", "")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(F.split(text, "\r?\n")).alias("_at", "payload")).select(*rest, F.col("_at").cast("long").alias(model.SEQ), "payload")
