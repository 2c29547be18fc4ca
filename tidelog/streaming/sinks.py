"""Sinks: where ``to`` delivers ``$payload``. All run inside a micro-batch (or on a batch).

Executors write: each task gets its rows in the order of ``_seq`` and reports what it
sent, so the driver only sees counts. Rows of one file (or one ordered connection) are
one task's.
"""

from __future__ import annotations

import fcntl
import json
import logging
import os
import shlex
import socket
import subprocess
import sys
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from .metrics import Metrics

CONNECT_TIMEOUT, RETRY_PAUSE = 2.0, 1.0
_SENT = "messages long, max_bytes long, total_bytes long"
_log = logging.getLogger("tidelog.sinks")


def terminated(payload: bytes) -> bytes:
    return payload if payload.endswith(b"\n") else payload + b"\n"


def _payloads(df: DataFrame, *more: Column) -> DataFrame:
    seq = F.col(model.SEQ) if model.SEQ in df.columns else F.lit(0).cast("long")
    return df.select(seq.alias("seq"), F.coalesce(model.raw(df, "payload").cast("string"), F.lit("")).cast("binary").alias("payload"), *more)


def _send(rows: DataFrame, send: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> tuple[int, int, int]:
    done = rows.mapInPandas(send, _SENT).agg(F.sum("messages"), F.max("max_bytes"), F.sum("total_bytes")).first()
    return tuple(int(x or 0) for x in done)


def _report(sizes: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"messages": [len(sizes)], "max_bytes": [max(sizes, default=0)], "total_bytes": [sum(sizes)]})


class _Appender:
    """One file, locked while it is written. A journal beside it says where each writer began its
    last batch; a writer that comes again with the same batch first cuts what it wrote then."""

    def __init__(self, path: str, writer: tuple[str, str, int] | None, name: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self._held = [out := open(path, "ab")]
        self.write = out.write
        if writer is None:
            return
        self._held.append(journal := open(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.journal"), "a+"))
        fcntl.flock(journal, fcntl.LOCK_EX)
        journal.seek(0)
        try:
            began = json.load(journal)
        except ValueError:  # new, or cut off by a crash
            began = {}
        stat = os.fstat(out.fileno())
        stream, sink, number = writer
        own, mine = f"{stream} {name}", f"{stream} {name} {sink}"
        was, at, inode = began.get(mine, (None, 0, None))
        later = [k for k, (_, offset, i) in began.items() if i == stat.st_ino and offset > at]
        if was == number and inode == stat.st_ino and at <= stat.st_size and all(k.startswith(f"{own} ") for k in later):
            out.truncate(at)
            for k in later:
                del began[k]
        else:
            began[mine] = [number, stat.st_size, stat.st_ino]
        journal.seek(0)
        journal.truncate()
        json.dump(began, journal)
        journal.flush()

    def close(self) -> None:
        for f in self._held:
            f.close()


def _write_files(writer: tuple[str, str, int] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out = None, None
        try:
            for batch in batches:
                sizes: list[int] = []
                for file, group in batch.groupby("file", sort=False):
                    path = os.path.realpath(file)
                    try:
                        if file != name:  # rows come by file: one is open at a time
                            if out is not None:
                                out.close()
                            name, out = file, None
                            out = _Appender(path, writer, file)
                        if out is None:
                            continue
                        for p in group["payload"]:
                            out.write(terminated(bytes(p)))
                            sizes.append(len(p))
                    except OSError as e:  # logged, never fatal
                        _log.error("cannot write %s: %s", path, e)
                yield _report(sizes)
        finally:
            if out is not None:
                out.close()

    return run


def to_file(df: DataFrame, name: Column, metrics: Metrics | None = None, writer: tuple[str, str, int] | None = None) -> int:
    """Append each payload to the file that its message names. ``writer``: the stream, the sink in
    it and the number of the batch; what that batch has appended before is cut first, unless
    another stream (or another name of the file) has appended after it."""
    rows = _payloads(df, name.alias("file")).repartition("file").sortWithinPartitions("file", "seq")
    sent = _send(rows, _write_files(writer))
    if metrics:
        metrics.transfer("toFile", *sent)
    return sent[0]


def _udp(address: tuple[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for batch in batches:
                sizes = []
                for p in batch["payload"]:
                    try:
                        s.sendto(bytes(p), address)
                        sizes.append(len(p))
                    except OSError as e:
                        _log.error("cannot send to %s:%s: %s", *address, e)
                yield _report(sizes)

    return run


def to_udp(df: DataFrame, address: tuple[str, int], metrics: Metrics | None = None) -> int:
    """A datagram for each payload."""
    sent = _send(_payloads(df).sortWithinPartitions("seq"), _udp(address))
    if metrics:
        metrics.transfer("toUdp", *sent)
    return sent[0]


#: Connections of this worker process, which Spark uses again for later micro-batches.
LINKS: dict[tuple[str, int], socket.socket] = {}


def _hung_up(link: socket.socket) -> bool:
    """Whether the other side has closed the connection."""
    link.setblocking(False)
    try:
        return link.recv(1, socket.MSG_PEEK) == b""
    except BlockingIOError:
        return False
    finally:
        link.settimeout(CONNECT_TIMEOUT)


def _tcp(address: tuple[str, int], give_up: float | None):
    def connect() -> socket.socket:
        began = time.monotonic()
        while True:
            try:
                return socket.create_connection(address, CONNECT_TIMEOUT)
            except OSError:
                if give_up is not None and time.monotonic() - began > give_up:
                    raise
                time.sleep(RETRY_PAUSE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.streaming.sinks import LINKS  # the worker's own, whatever this function was sent with

        for batch in batches:
            sizes = []
            for p in batch["payload"]:
                while True:
                    try:
                        if address not in LINKS or _hung_up(LINKS[address]):
                            LINKS[address] = connect()
                        LINKS[address].sendall(terminated(bytes(p)))
                        break
                    except OSError:
                        if address not in LINKS:
                            raise
                        LINKS.pop(address).close()
                sizes.append(len(p))
            yield _report(sizes)

    return run


def to_tcp(df: DataFrame, address: tuple[str, int], metrics: Metrics | None = None, give_up: float | None = None) -> int:
    """Lines in order over one connection, which stays open; retried until they are sent (at least once)."""
    sent = _send(_payloads(df).coalesce(1).sortWithinPartitions("seq"), _tcp(address, give_up))
    if metrics:
        metrics.transfer("toTcp", *sent)
    return sent[0]


class ShellSink:
    """A long-lived child process of the driver; payloads go to its input, line by line."""

    _held: dict[str, ShellSink] = {}
    _lock = threading.Lock()

    def __init__(self, command: str):
        self.argv, self._child, self._last = shlex.split(command), None, 0.0

    @classmethod
    def of(cls, command: str) -> ShellSink:
        with cls._lock:
            return cls._held.setdefault(command, cls(command))

    def _started(self) -> subprocess.Popen:
        if self._child is None or self._child.poll() is not None:
            time.sleep(max(0.0, self._last + RETRY_PAUSE - time.monotonic()))
            self._last = time.monotonic()
            self._child = subprocess.Popen(self.argv, stdin=subprocess.PIPE)
        return self._child

    def write(self, payload: bytes) -> None:
        while True:
            try:
                child = self._started()
                child.stdin.write(terminated(payload))
                child.stdin.flush()
                return
            except (BrokenPipeError, OSError) as e:
                _log.error("child process: %s", e)
                if not isinstance(e, BrokenPipeError):
                    raise

    def close(self) -> None:
        if self._child is not None:
            self._child.stdin.close()
            self._child.wait(5)
            self._child = None


def to_shell(df: DataFrame, command: str, metrics: Metrics | None = None) -> int:
    """Payloads to one child of the driver, in order; rows are streamed, not collected."""
    sink, sizes = ShellSink.of(command), [0, 0, 0]
    for row in _payloads(df).orderBy("seq").toLocalIterator(prefetchPartitions=True):
        sink.write(bytes(row["payload"]))
        sizes = [sizes[0] + 1, max(sizes[1], len(row["payload"])), sizes[2] + len(row["payload"])]
    if metrics:
        metrics.transfer("toShell", *sizes)
    return sizes[0]


def to_stdout(df: DataFrame, out=None, prefix: str = "") -> int:
    """Print payloads in order; ``prefix`` is put before each line."""
    out, n = out or sys.stdout, 0
    for row in _payloads(df).orderBy("seq").toLocalIterator(prefetchPartitions=True):
        text = terminated(bytes(row["payload"])).decode(errors="replace")
        out.write("".join(prefix + line for line in text.splitlines(keepends=True)) if prefix else text)
        n += 1
    return n


class MemorySink:
    """Collects payloads by name: for tests and small previews."""

    _held: dict[str, list[str]] = {}

    @classmethod
    def rows(cls, name: str = "default") -> list[str]:
        return cls._held.setdefault(name, [])

    @classmethod
    def write(cls, df: DataFrame, name: str = "default") -> int:
        got = [bytes(r["payload"]).decode(errors="replace") for r in _payloads(df).orderBy("seq").collect()]
        cls.rows(name).extend(got)
        return len(got)
