"""The bounded queue between a receiver and the engine, and its model over tables.

Messages queue up in chunks. The first chunk (being read) and the last (being filled)
are free; the chunks between them are held packed and, if asked, compressed, within a
memory limit that all queues of a buffer share. A chunk that doesn't fit pushes out the
oldest buffered chunks of any queue, whose messages count as overflow.
"""

from __future__ import annotations

import logging
import threading
import time
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import packs
from .metrics import Metrics

DEFAULT_BYTES, DEFAULT_CHUNK, RANGE = 128 << 20, 500, 4096
_LZ4, _log = pa.Codec("lz4_raw"), logging.getLogger("tidelog.buffer")


def _compress(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _LZ4.compress(data, asbytes=True)


def _decompress(data: bytes) -> bytes:
    return _LZ4.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


class Buffer:
    """The shared memory of several queues. ``compression``: 'off', or 'fast' (LZ4)."""

    def __init__(self, limit: int = DEFAULT_BYTES, compression: str = "fast", metrics: Metrics | None = None, name: str = "defaultBuffer"):
        self.limit, self.compression, self.metrics, self.name = limit, compression, metrics, name
        self.used, self.lock, self._order = 0, threading.RLock(), deque()

    def allocate(self, chunk: _Chunk) -> None:
        size = len(chunk.packed)
        if size > self.limit:  # lost by itself: nothing else makes room for it
            _log.error("a chunk of %s bytes doesn't fit a buffer of %s: its messages are lost", size, self.limit)
            chunk.packed = None
            chunk.queue._lose(chunk)
            return
        with self.lock:
            while self.used + size > self.limit:
                old = self._order.popleft()
                if old.packed is not None:
                    self.used -= len(old.packed)
                    old.queue._lose(old)
            self.used += size
            self._order.append(chunk)
            if self.metrics:
                for n in (self.name, "allBuffers"):
                    self.metrics.add(f"{n}AllocatedBytes", size)
                    self.metrics.add(f"{n}MaxBytes", self.used)

    def release(self, chunk: _Chunk) -> None:
        with self.lock:
            if chunk in self._order:
                self._order.remove(chunk)
                self.used -= len(chunk.packed)


class _Chunk:
    __slots__ = ("queue", "messages", "packed", "count")

    def __init__(self, queue: Queue):
        self.queue, self.messages, self.packed, self.count = queue, [], None, 0


class Queue:
    """FIFO of messages (dicts of bytes); ``put`` never blocks, ``take`` gives what is there."""

    def __init__(self, buffer: Buffer, chunk_messages: int = DEFAULT_CHUNK):
        self.buffer, self.size, self.metrics = buffer, chunk_messages, buffer.metrics
        self._chunks: deque[_Chunk] = deque()
        self.overflow = 0

    def _timed(self, name: str, run: Callable, *args):
        began = time.perf_counter_ns()
        out = run(*args)
        if self.metrics:
            took = time.perf_counter_ns() - began
            self.metrics.add(f"{name}Count")
            self.metrics.add(f"{name}DurationMaxNanos", took)
            self.metrics.add(f"{name}DurationTotalNanos", took)
        return out

    def _pack(self, chunk: _Chunk) -> None:
        data = self._timed("pack", packs.encode, chunk.messages)
        if self.buffer.compression != "off":
            whole = len(data)
            data = self._timed("compress", _compress, data)
            if self.metrics:
                self.metrics.add("compressBeforeTotalBytes", whole)
                self.metrics.add("compressAfterTotalBytes", len(data))
        chunk.packed, chunk.messages = data, []
        self.buffer.allocate(chunk)

    def _unpack(self, chunk: _Chunk) -> list[dict[str, bytes]]:
        if chunk.packed is None:
            return chunk.messages
        self.buffer.release(chunk)
        data = chunk.packed if self.buffer.compression == "off" else self._timed("decompress", _decompress, chunk.packed)
        return self._timed("unpack", packs.decode, data)

    def _lose(self, chunk: _Chunk) -> None:
        self._chunks.remove(chunk)
        self.overflow += chunk.count
        if self.metrics:
            self.metrics.add("queueOverflows", chunk.count)

    def put(self, message: dict[str, bytes]) -> None:
        with self.buffer.lock:
            if not self._chunks or self._chunks[-1].count >= self.size:
                if len(self._chunks) >= 2:  # the last chunk becomes a middle one
                    self._pack(self._chunks[-1])
                self._chunks.append(_Chunk(self))
                if self.metrics:
                    self.metrics.add("queueChunksCreated")
            last = self._chunks[-1]
            last.messages.append(message)
            last.count += 1
            if self.metrics:
                self.metrics.add("queueMaxSize", len(self))

    def take(self) -> list[dict[str, bytes]]:
        """The oldest chunk's messages; an empty list if nothing waits."""
        with self.buffer.lock:
            return self._unpack(self._chunks.popleft()) if self._chunks else []

    def __len__(self) -> int:
        return sum(c.count for c in self._chunks)


def survivors(df: DataFrame, order: Column, size: Column, limit: int, chunk: int) -> DataFrame:
    """What a burst leaves: rows numbered by ``order`` in chunks of ``chunk``; the first and
    last chunk, and of those between the newest whose bytes fit ``limit``. Chunk sums come
    first, and running sums within ranges of ``RANGE`` chunks: one task orders the ranges only."""
    numbered = df.withColumn("_chunk", F.floor(order / chunk))
    chunks = numbered.groupBy("_chunk").agg(F.sum(size).alias("_bytes"))
    ends = chunks.agg(F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last"))
    chunks = chunks.crossJoin(F.broadcast(ends))  # ends: one row
    middle = chunks.where((F.col("_chunk") > F.col("_first")) & (F.col("_chunk") < F.col("_last")))
    middle = middle.withColumn("_range", F.floor(F.col("_chunk") / RANGE))
    newer = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = middle.groupBy("_range").agg(F.sum("_bytes").alias("_whole")).select("_range", F.coalesce(F.sum("_whole").over(newer), F.lit(0)).alias("_newer"))
    within = F.sum("_bytes").over(Window.partitionBy("_range").orderBy(F.col("_chunk").desc()))
    kept = middle.join(before.where(F.col("_newer") <= limit), "_range").withColumn("_held", within + F.col("_newer")).where(F.col("_held") <= limit).select("_chunk")
    edge = chunks.where((F.col("_chunk") == F.col("_first")) | (F.col("_chunk") == F.col("_last"))).select("_chunk")
    return numbered.join(kept.unionByName(edge), "_chunk", "left_semi").drop("_chunk")
