"""Helpers shared by the corpus operators: scratch tables, joins, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many 8-byte keys a side may be broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Bytes up to which other sides may be broadcast, as summed over their rows.
BROADCAST_BYTES = 16 << 20
#: Rows of a stored table that a task writes, where the number of rows is known.
ROWS_PER_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this machine only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        else:
            root = tempfile.mkdtemp(prefix="tidelog-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tidelog/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives lost executors.
    ``rows``: about as many as the last stage works on; they size its tasks (ROWS_PER_TASK, but
    no fewer tasks than cores), so that a small table isn't hundreds of files. The table goes
    with the session, or before (``release``)."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
    path = scratch_path(spark, name)
    made(spark, path)
    # the path is new, so appending is writing; nothing asks for the marker of success
    df.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, path: str) -> None:
    """The folders that a write to ``path`` begins with, where ``path`` is a folder of this machine.
    Hadoop starts a process (chmod) on the driver for each folder and file that it makes there
    itself, and until that runs its own program it counts as a second driver of the same memory."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
        jvm.java.io.File(p.toUri().getPath(), "_temporary/0").mkdirs()


#: Paths of stored tables by application.
_held: dict[str, list[str]] = {}


def mark(spark: SparkSession) -> int:
    """How many stored tables there are, for ``release``."""
    return len(_held.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, since: int, unless: DataFrame) -> None:
    """Remove the tables stored after ``since``, unless ``unless`` reads them. Only for tables
    that nothing else will read: their frames must have been written or collected."""
    paths = _held.get(spark.sparkContext.applicationId, [])
    read = unless.inputFiles() if len(paths) > since else []
    for path in paths[since:]:
        tail = path.rsplit("/", 1)[1]
        if not any(f"/{tail}/" in f for f in read):
            remove_path(spark, path)
            paths.remove(path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep_keys(df: DataFrame, keys: DataFrame, on: str, n_keys: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``. The keys are broadcast only when they
    are counted and few (8 bytes each); otherwise both sides are shuffled."""
    if n_keys is None:
        n_keys = keys.count()
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    return df.join(side, on, "left_semi")


# --- Arrow text batches -------------------------------------------------------------

#: Text bytes that one vectorised step works on; a longer text is one step by itself.
STEP_BYTES = 1 << 21


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its len+1 offsets; null is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    buffers = arr.buffers()
    off = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    if buffers[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut by rows so that each has about STEP_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_long(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)
