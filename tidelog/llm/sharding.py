"""Sharding by size-tiered compaction (DataFrame functions only).

``append`` writes arrivals as small immutable shards (files). ``compact`` groups shards
into tiers by size, powers of ``fan_in`` below the target, and merges a tier that holds
``fan_in`` shards or more into files of the target size; a merge reads and writes its
shards once, without a shuffle. Nothing is changed in place: each step ends by
committing a new manifest version, a JSON-lines file (the store's schema, then a line for
each shard). A version is claimed by creating a file of its name exclusively, then
renamed to its place, where readers find it whole or not at all; exclusive creation is the
file system's (HDFS: atomic; a local disk: between threads and, but for an instant,
processes; object stores: where they have conditional writes). A writer whose version is
taken commits again on top of the newer one. ``vacuum`` removes what no recent version
names and is older than any writer may take. What the driver holds is the manifest.

Defined results: nulls, empty and very long texts and repeated rows are stored as they
are; an empty arrival commits a version without new shards; all columns of all arrivals
are kept, null where an arrival lacks them; a column that arrives with another type than
it is stored with is refused.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TARGET_BYTES, FAN_IN, ARRIVAL_ROWS = 64 << 20, 4, 5_000
#: Arrivals of the registered query; commits tried; seconds after which a claim or a file is abandoned.
ARRIVALS, TRIES, STALE_SECONDS = 5, 20, 3600


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, arrival_rows: int = ARRIVAL_ROWS):
        self.spark, self.root, self.target, self.fan_in, self.arrival_rows = spark, root.rstrip("/"), target_bytes, fan_in, arrival_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifest ---------------------------------------------------------------------

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:-6]) for n in names if n.startswith("v") and n.endswith(".jsonl"))])

    def manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.jsonl"

    def _lines(self, version: int) -> list[dict]:
        stream = self._fs.open(self._path(self.manifest_path(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines() if line]

    def shards(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        return self._lines(version)[1:] if version else []

    def schema(self, version: int | None = None) -> T.StructType:
        version = self.version() if version is None else version
        return T.StructType.fromJson(self._lines(version)[0]["schema"]) if version else T.StructType([])

    def _with(self, stored: T.StructType, more: T.StructType) -> T.StructType:
        """``stored`` with the columns of ``more`` that it lacks."""
        sensitive = self.spark.conf.get("spark.sql.caseSensitive", "false") == "true"
        key = (lambda n: n) if sensitive else str.lower
        held = {key(f.name): f for f in stored.fields}
        for f in more.fields:
            if held.setdefault(key(f.name), f).dataType != f.dataType:
                raise ValueError(f"column {f.name} is stored as {held[key(f.name)].dataType.simpleString()} and arrives as {f.dataType.simpleString()}")
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in held.values()])

    def _claim(self, version: int) -> bool:
        """Whether this writer, and no other, may write ``version``."""
        claim = self._path(f"{self.root}/manifest/.claim-v{version:08d}")
        for _ in range(2):
            try:
                self._fs.create(claim, False).close()
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()) and "already exists" not in str(e.java_exception):
                    raise
            if self.version() >= version or not self._fs.exists(claim) or time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 < STALE_SECONDS:
                return False
            self._fs.delete(claim, False)  # its writer has died
        return False

    def commit(self, shards: list[dict], based_on: int, schema: T.StructType | None = None) -> int:
        """Publish the next version, atomically, unless somebody else has."""
        version, schema = based_on + 1, self.schema(based_on) if schema is None else schema
        final, draft = self._path(self.manifest_path(version)), self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        if self._fs.exists(final) or not self._claim(version):
            raise CommitConflict(f"version {version} exists")
        out = self._fs.create(draft, False)
        lines = [{"schema": schema.jsonValue()}, *({**s, "shard_id": i} for i, s in enumerate(shards))]
        out.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version} exists")
        return version

    def _commit_on_top(self, change) -> int:
        """Commit ``change(shards, schema)`` (None: nothing to do any more), again if another writer was faster."""
        for attempt in range(TRIES):
            at = self.version()
            made = change(self.shards(at), self.schema(at))
            if made is None:
                return at
            try:
                return self.commit(made[0], at, made[1])
            except CommitConflict:
                if attempt + 1 == TRIES:
                    raise
                time.sleep(0.05 * (attempt + 1))

    # --- writing ----------------------------------------------------------------------

    def _write(self, df: DataFrame, **options: int) -> list[dict]:
        run = f"run-{uuid.uuid4().hex[:12]}"
        df.write.options(compression="zstd", **options).parquet(f"{self.root}/{run}")
        files = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(f"{self.root}/{run}"))]
        return [{"file": f"{run}/{n}", "bytes": b} for n, b in sorted(files) if n.endswith(".parquet")]

    def append(self, arrivals: DataFrame) -> int:
        """New shards of at most ``arrival_rows`` rows each; the new version."""
        self._with(self.schema(), arrivals.schema)  # refused before anything is written
        new = self._write(arrivals, maxRecordsPerFile=self.arrival_rows)
        return self._commit_on_top(lambda shards, schema: (shards + new, self._with(schema, arrivals.schema)))

    def tier(self, size: int) -> int:
        """0: at least half the target, never merged again; n: about target / fan_in**n."""
        return 0 if 2 * size >= self.target else math.ceil(math.log(self.target / max(size, 1), self.fan_in))

    def compact(self) -> int:
        """Merge tiers until none has ``fan_in`` shards; the last version."""
        while True:
            at = self.version()
            shards = self.shards(at)
            tiers: dict[int, list[dict]] = {}
            for s in shards:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [t for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= self.fan_in]
            if not full:
                return at
            old = tiers[full[0]]
            rows = self.spark.read.schema(self.schema(at)).parquet(*[f"{self.root}/{s['file']}" for s in old])
            merged = self._write(rows.coalesce(max(1, round(sum(s["bytes"] for s in old) / self.target))))
            gone = {s["file"] for s in old}

            def swapped(now: list[dict], schema: T.StructType):
                if not gone <= {s["file"] for s in now}:
                    return None  # another writer has merged some of them: these files stay unnamed
                return [s for s in now if s["file"] not in gone] + merged, schema

            self._commit_on_top(swapped)

    def vacuum(self, keep: int = 1, older_than: float = STALE_SECONDS) -> None:
        """Remove files that none of the last ``keep`` versions names and that are older than
        ``older_than`` seconds: longer than a writer takes from its first file to its commit,
        and a reader from a version to its last file."""
        now, oldest = self.version(), time.time() - older_than
        kept = range(max(1, now - keep + 1), now + 1)
        named = {s["file"] for v in kept for s in self.shards(v)}
        for folder in self._fs.listStatus(self._path(self.root)):
            run = folder.getPath().getName()
            if not run.startswith("run-"):
                continue
            files = list(self._fs.listStatus(folder.getPath()))
            if any(f.getModificationTime() / 1000 > oldest for f in [folder, *files]):
                continue
            live = [f for f in files if f"{run}/{f.getPath().getName()}" in named]
            if not live:
                self._fs.delete(folder.getPath(), True)
                continue
            for f in files:
                if f.getPath().getName().endswith(".parquet") and f not in live:
                    self._fs.delete(f.getPath(), False)

    # --- reading ----------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with ``shard_file``, ``shard_id`` and ``shard_bytes``; stored columns
        of these names come back with ``row_`` before them."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the store is empty")
        shards, schema = self.shards(version), self.schema(version)
        if not shards:
            nothing = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
            return nothing.select("*", F.lit("").alias("shard_file"), F.lit(0).cast("long").alias("shard_id"), F.lit(0).cast("long").alias("shard_bytes"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['file']}" for s in shards])
        file = F.regexp_extract(F.col("_metadata.file_path"), r"(run-[0-9a-f]+/[^/]+)$", 1)
        rows = rows.select(*[F.col(f"`{c}`").alias(f"row_{c}" if c in ("shard_file", "shard_id", "shard_bytes") else c) for c in rows.columns], file.alias("shard_file"))
        listed = self.spark.read.schema("file string, bytes long, shard_id long").json(self.manifest_path(version)).where("file is not null")
        listed = listed.select(F.col("file").alias("shard_file"), "shard_id", F.col("bytes").alias("shard_bytes"))
        return rows.join(F.broadcast(listed) if len(shards) <= 100_000 else listed, "shard_file")


def shard(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, **options) -> tuple[ShardStore, int]:
    """All of ``docs`` in ``arrivals`` appends (by hash of doc_id), each followed by compaction."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or common.scratch_path(spark, "shards"), **options)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    version = store.version()
    for i in range(arrivals):
        store.append(docs.where(part == i))
        version = store.compact()
    return store, version


#: What was sharded, whole; that all shards are within the target is the query's to say.
ORACLE = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, text IS NULL AS no_text, true AS within_target FROM documents
"""
