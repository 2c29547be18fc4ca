"""Self-metrics: counters with reset on read, gauges, and their text renderings."""

from __future__ import annotations

import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSPORTS = ("fromUdp", "fromTcp", "toUdp", "toTcp", "toFile", "toShell")
TIMINGS = ("pack", "unpack", "compress", "decompress")
GAUGES = ("uptimeSeconds", "heapBytes", "heapUsedBytes", "heapMaxBytes")
#: Counter to its aggregate: count, sum or max.
COUNTERS: dict[str, str] = (
    {f"{t}{n}": a for t in TRANSPORTS for n, a in (("Messages", "count"), ("MaxBytes", "max"), ("TotalBytes", "sum"))}
    | {f"{o}{n}": a for o in TIMINGS for n, a in (("Count", "count"), ("DurationMaxNanos", "max"), ("DurationTotalNanos", "sum"))}
    | {"compressBeforeTotalBytes": "sum", "compressAfterTotalBytes": "sum"}
    | {"fromTcpNewConnections": "count", "messagesReceived": "count", "messagesSent": "count", "configReloads": "count", "unparsedDropped": "count"}
    | {"queueOverflows": "sum", "queueMaxSize": "max", "queueChunksCreated": "count"}
    | {"defaultBufferMaxBytes": "max", "allBuffersMaxBytes": "max", "defaultBufferAllocatedBytes": "sum", "allBuffersAllocatedBytes": "sum"}
)
NAMES = (*COUNTERS, *GAUGES)


class Holder:
    """One consumer's counters."""

    def __init__(self):
        self._lock, self._values = threading.Lock(), dict.fromkeys(COUNTERS, 0)

    def add(self, name: str, n: int) -> None:
        with self._lock:
            old = self._values[name]
            self._values[name] = max(old, n) if COUNTERS[name] == "max" else old + n

    def read(self, reset: bool) -> dict[str, int]:
        with self._lock:
            out = dict(self._values)
            if reset:
                self._values = dict.fromkeys(COUNTERS, 0)
        return out


class Metrics:
    """Every event goes to every holder; each consumer reads and resets its own."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark, self._began, self._holders = spark, time.monotonic(), {}

    def holder(self, consumer: str) -> Holder:
        return self._holders.setdefault(consumer, Holder())

    @property
    def wanted(self) -> bool:
        return bool(self._holders)

    def add(self, name: str, n: int = 1) -> None:
        for h in list(self._holders.values()):
            h.add(name, n)

    def transfer(self, transport: str, messages: int, max_bytes: int, total_bytes: int) -> None:
        if messages:
            self.add(f"{transport}Messages", messages)
            self.add(f"{transport}MaxBytes", max_bytes)
            self.add(f"{transport}TotalBytes", total_bytes)
            self.add("messagesReceived" if transport.startswith("from") else "messagesSent", messages)

    def gauges(self) -> dict[str, int]:
        heap = dict.fromkeys(GAUGES, 0) | {"uptimeSeconds": int(time.monotonic() - self._began)}
        if self._spark is not None:
            run = self._spark._jvm.java.lang.Runtime.getRuntime()
            heap |= {"heapBytes": run.totalMemory(), "heapUsedBytes": run.totalMemory() - run.freeMemory(), "heapMaxBytes": run.maxMemory()}
        return heap

    def snapshot(self, consumer: str, reset: bool = True) -> dict[str, int]:
        return self.holder(consumer).read(reset) | self.gauges()


def transfer_stats(df: DataFrame, column: str = "payload") -> DataFrame:
    """Messages, largest and total bytes of a stream, as one distributed aggregate."""
    size = F.octet_length(F.coalesce(F.col(column), F.lit("")))
    return df.agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_bytes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"))


# --- renderings ---------------------------------------------------------------------------


def human_bytes(n: int) -> str:
    for unit, size in (("G", 1 << 30), ("M", 1 << 20), ("K", 1 << 10)):
        if n >= size:
            x = n / size
            return f"{x:.0f}{unit}" if x > 99 else f"{x:.1f}".removesuffix(".0") + unit
    return str(n)


def human_seconds(n: int) -> str:
    out = ""
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60)):
        if n >= size:
            out += f"{n // size}{unit}"
            n %= size
    return out + f"{n}s" if n or not out else out


def summary(snapshot: dict[str, int]) -> str:
    """``name value`` pairs by name, in kebab case and human units."""
    pairs = []
    for name in sorted(snapshot):
        value = snapshot[name]
        text = human_bytes(value) if name.endswith("Bytes") else human_seconds(value) if name.endswith("Seconds") else str(value)
        short = re.sub(r"(?:Bytes|Seconds)$", "", name)
        pairs.append(re.sub(r"[A-Z]", lambda m: f"-{m[0].lower()}", short) + f" {text}")
    return " ".join(pairs)


def influx_values(snapshot: dict[str, int]) -> str:
    return ",".join(f"{k}={snapshot[k]}" for k in sorted(snapshot))


def prometheus(snapshot: dict[str, int], prefix: str = "tidelog") -> str:
    """Prometheus text; maxima since the last read make no sense there and are left out."""
    out = []
    for name in sorted(snapshot):
        if re.search(r"Max(?:Bytes|Nanos|Size)$", name) and name not in GAUGES:
            continue
        full = f"{prefix}_" + re.sub(r"[A-Z]", lambda m: f"_{m[0].lower()}", name)
        out += [f"# TYPE {full} {'gauge' if name in GAUGES else 'counter'}", f"{full} {snapshot[name]}"]
    return "\n".join(out) + "\n"


class PrometheusServer:
    """GET on any path gives the metrics; they are never reset."""

    def __init__(self, metrics: Metrics, host: str = "0.0.0.0", port: int = 0):
        metrics.holder("prometheus")

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                body = prometheus(metrics.snapshot("prometheus", reset=False)).encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.port = self._server.server_address[1]
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()
