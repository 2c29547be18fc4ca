"""Substring deduplication on a log-structured fingerprint index.

Every window of ``window`` consecutive words selects one anchor: the smallest of its
``anchor``-word hashes. Equal windows select equal anchors, so only windows that share
an anchor can be equal, and an index of anchors, about 2 / (window - anchor + 2) rows a
word, stands for all windows. Consecutive windows with equal anchors (in repetitive text
there may be many) form a *span*, kept as one index row: (anchor hash, 128-bit digest of the span's whole
word sequence, doc_id, first window, windows).

Index: immutable runs, each a table bucketed and sorted by anchor hash. What a task sees
of a digest within about 2 MB of text goes into the run as one row, its first document's
first span, so that a passage of very many documents is few rows. A batch becomes a run of its own and is
merge-joined with the sorted runs of all batches before it, bucket by bucket, without
moving or sorting them; only what shares an anchor with the batch is read on. Once there
are ``max_runs`` runs, they are compacted into one before the next batch.

A batch's span whose digest an earlier document has is a repeat with all its windows.
Where an anchor has digests of several documents, the spans agree in part at most: the
windows of each digest's first document are made from the texts (of these documents
alone) and compared by 128-bit hashes of their whole word sequences (verification).

First documents of digests and windows are joined back to stored tables, so that a
passage that a third of all documents hold is many tasks' work.

Defined results: a null text has no words; a text of fewer words than ``window`` keeps
all; a null doc_id is neither compared nor cut; rows that share a doc_id are repeated
rows of one document and never cut one another, and each is cut by its own text; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .wordhash import WORD_BASE_2, U, WindowHash, Words, mix, starts_within

WINDOW, ANCHOR = 50, 16
#: Runs that are compacted before the next batch; batches of the registered query.
MAX_RUNS, BATCHES = 2, 3
SPAN = T.StructType([T.StructField(n, t) for n, t in (("h", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("doc_id", T.LongType()), ("tkey", T.LongType()), ("pos", T.IntegerType()), ("cnt", T.IntegerType()), ("last", T.LongType()))])
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def spans_of(texts: pa.Array, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window counted from the document's first word, windows, anchor hash, digest, digest)."""
    words = Words(texts)
    wide = window - anchor + 1
    at, doc = starts_within(words.count, words.doc_at, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U), none.view(U)
    h = words.hashes()
    one, two = WindowHash(h), WindowHash(mix(h ^ U(0x5851F42D4C957F2D)), WORD_BASE_2)
    n = len(h) - anchor + 1
    grams = one.at(np.arange(n), anchor)
    least = np.empty(len(at), U)
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)
    for i in range(0, len(at), 1 << 16):  # the windows of a document follow one another: rows of the view
        part = at[i : i + (1 << 16)]
        least[i : i + (1 << 16)] = view[part].min(axis=1)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    cnt = np.diff(np.append(first, len(at)))
    begin, shape = at[first], mix(cnt.astype(U))
    long = cnt + window - 1
    d1, d2 = mix(one.at(begin, long) ^ shape), mix(two.at(begin, long) + shape)
    return doc[first], begin - words.doc_at[doc[first]], cnt, least[first], d1, d2


def _last_of(h: np.ndarray, d1: np.ndarray, d2: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.Array:
    """For the first row of each digest, by document and place, the last document that has it; null for the others."""
    last, first = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((pos, ids, d2, d1, h))
        a, b, c = h[order], d1[order], d2[order]
        new = np.ones(len(h), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        first[order[at]] = True
        last[order[at]] = ids[order[np.append(at[1:], len(h)) - 1]]
    return pa.array(last, mask=~first)


def _fingerprint(window: int, anchor: int):
    schema = pa.schema([("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32()), ("cnt", pa.int32()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            doc, pos, cnt, h, d1, d2 = spans_of(b.column("text"), window, anchor)
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "tkey"))
            hashes = [pa.array(common.as_long(x)) for x in (h, d1, d2)]
            last = _last_of(h, d1, d2, ids, pos)
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(pos.astype(np.int32)), pa.array(cnt.astype(np.int32)), last], schema=schema)

    return run


def _windows(window: int):
    """Rows (doc_id, tkey, text, spans) to rows (w1, w2, doc_id, tkey, start), one for each window of the spans."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            words = Words(b.column("text"))
            h = words.hashes()
            one, two = WindowHash(h), WindowHash(mix(h ^ U(0x5851F42D4C957F2D)), WORD_BASE_2)
            spans = b.column("spans")
            flat = spans.flatten()
            doc = np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            pos, cnt = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            start = np.repeat(pos - np.concatenate([[0], np.cumsum(cnt)[:-1]]).astype(np.int64)[: len(pos)], cnt) + np.arange(cnt.sum())
            doc = np.repeat(doc, cnt)
            at = words.doc_at[doc] + start
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "tkey"))
            yield pa.RecordBatch.from_arrays([pa.array(common.as_long(one.at(at, window))), pa.array(common.as_long(two.at(at, window))), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(start.astype(np.int32))], schema=schema)

    return run


def cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The kept words, and how many words the (first word, words) spans cover."""
    words = (text or "").encode().split()
    if not spans:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int64)
    for at, n in spans:
        gone[min(at, len(words))] += 1
        gone[min(at + n, len(words))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if with_text else {})
            for i, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                kept, gone = cut(text, [(s["pos"], s["cnt"]) for s in spans or ()])
                joined = b" ".join(kept)
                out["doc_id"].append(i)
                out["n_words"].append(len(kept) + gone)
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    out["kept"].append(joined.decode())
            types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], names=list(out))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tkey): rows that share a doc_id are told apart by a hash of their text."""
    if docs.columns == ["doc_id", "text", "tkey"]:
        return docs
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))


class FingerprintIndex:
    """The log-structured index. ``ingest`` takes batches in the order of their doc_ids:
    a batch is judged against itself and every batch before it."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, buckets: int | None = None, max_runs: int = MAX_RUNS):
        if not 0 < anchor <= window:
            raise ValueError("anchor must be from 1 to window")
        self.spark, self.window, self.anchor, self.max_runs = spark, window, anchor, max(1, max_runs)
        self.buckets = buckets or common.shuffle_partitions(spark)
        self.name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.runs: list[str] = []
        self._made = 0
        # a run has one sorted file for each bucket: merge-joins needn't sort it again
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _append(self, rows: DataFrame) -> None:
        """A run of ``rows`` (h, d1, d2, spot, last)."""
        name, order = f"{self.name}_{self._made}", ("h", "d1", "d2")
        rows.repartition(self.buckets, "h").sortWithinPartitions(*order).write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "h").sortBy(*order).saveAsTable(name)
        self.runs.append(name)
        self._made += 1

    def _digests(self, runs: list[DataFrame]) -> DataFrame:
        """Of each digest of ``runs`` the first document's first span, and the last document."""
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        if len(runs) > 1:
            rows = rows.repartition(self.buckets, "h")
        return rows.groupBy("h", "d1", "d2").agg(F.min("spot").alias("spot"), F.max("last").alias("last"))

    def compact(self) -> None:
        """Merge all runs into one, with one row for each digest."""
        old, self.runs = self.runs, []
        # stored first: a repartition right above an aggregate by the same key would be left out, and a bucket get several files
        self._append(common.stored(self._digests([self.spark.table(run) for run in old]), "compacted", self.buckets * common.ROWS_PER_TASK // 8))
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []

    def ingest(self, batch: DataFrame, store: DataFrame, first_id: int | None = None) -> DataFrame:
        """Append ``batch`` (doc_id, text) and return its repeats: (doc_id, tkey, spans array of
        (pos, cnt) in words). ``store`` gives the texts of all documents so far, the batch
        included (best from a ``TextStore``); ``first_id`` is the batch's smallest doc_id, when history exists."""
        if len(self.runs) >= self.max_runs and len(self.runs) > 1:
            self.compact()
        history = list(self.runs)
        batch = _keyed(batch).where("doc_id is not null")
        n_docs = batch.count()
        prints = common.stored(batch.mapInArrow(_fingerprint(self.window, self.anchor), SPAN), "prints", n_docs)
        self._append(prints.where("last is not null").select("h", "d1", "d2", F.struct("doc_id", "tkey", "pos", "cnt").alias("spot"), "last"))
        own = self.spark.table(self.runs[-1])
        known = self._digests([own, *[self.spark.table(run).join(own.select("h").hint("merge"), "h", "left_semi") for run in history]])
        over = lambda f, c: f(c).over(Window.partitionBy("h"))
        several = (over(F.min, F.struct("d1", "d2")) < over(F.max, F.struct("d1", "d2"))) & (over(F.min, F.col("spot.doc_id")) < over(F.max, F.col("spot.doc_id")))
        firsts = known.withColumn("part", several).where(F.col("part") | (F.col("last") > F.col("spot.doc_id")))
        firsts = common.stored(firsts.select("h", "d1", "d2", "spot", "part"), "firsts", n_docs)
        first = firsts.select("h", "d1", "d2", F.col("spot.doc_id").alias("first_doc"), "part")
        seen = prints.join(first, ["h", "d1", "d2"]).where((F.col("doc_id") > F.col("first_doc")) | F.col("part"))
        seen = common.stored(seen.select("doc_id", "tkey", "pos", "cnt", (F.col("doc_id") > F.col("first_doc")).alias("whole")), "spans", n_docs)
        whole = seen.where("whole").select("doc_id", "tkey", "pos", (F.col("cnt") + (self.window - 1)).alias("cnt"))
        part = seen.where("not whole").drop("whole")
        if first_id is not None:
            part = part.unionByName(firsts.where(F.col("part") & (F.col("spot.doc_id") < first_id)).select("spot.*"))
        part = common.stored(part.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set(F.struct("pos", "cnt"))).alias("spans")), "parts", n_docs)
        windows = common.stored(self._texts(store, part).mapInArrow(_windows(self.window), "w1 long, w2 long, doc_id long, tkey long, start int"), "windows", n_docs)
        earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
        earliest = common.stored(earliest, "earliest", n_docs)
        new = F.lit(True) if first_id is None else F.col("doc_id") >= first_id
        partly = windows.where(new).join(earliest, ["w1", "w2"]).where("doc_id > first_doc").select("doc_id", "tkey", F.col("start").alias("pos"), F.lit(self.window).alias("cnt"))
        return common.stored(whole.unionByName(partly).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("pos", "cnt")).alias("spans")), "repeats", n_docs)

    def _texts(self, store: DataFrame, part: DataFrame) -> DataFrame:
        """The rows of ``store`` that ``part`` names, with its spans."""
        return _keyed(store).where("doc_id is not null").join(part, ["doc_id", "tkey"])


def remove(docs: DataFrame, repeats: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of ``docs``."""
    return _keyed(docs).join(repeats, ["doc_id", "tkey"], "left").mapInArrow(_kept(with_text), KEPT + (", kept string" if with_text else ""))


class TextStore:
    """The texts, moved once: a table bucketed and sorted by (doc_id, tkey), to which spans are
    joined without moving texts again. Rows without doc_id aren't in it."""

    def __init__(self, docs: DataFrame):
        self.spark, self.name, keys = docs.sparkSession, f"texts_{uuid.uuid4().hex[:12]}", ("doc_id", "tkey")
        n = common.shuffle_partitions(self.spark)
        rows = _keyed(docs).where("doc_id is not null").repartition(n, *keys).sortWithinPartitions(*keys)
        rows.write.format("parquet").option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def dedup_substrings(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """All of ``docs`` through an index, in ``batches`` batches of ascending doc_id."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, anchor)
    texts = TextStore(docs)
    low = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000).alias("q")).first()[0] if batches > 1 else []
    edges = [None, *sorted({int(x) + 1 for x in low or []}), None]
    found = None
    for a, b in zip(edges, edges[1:]):
        batch = docs if a is None else docs.where(F.col("doc_id") >= a)
        batch = batch if b is None else batch.where(F.col("doc_id") < b)
        store = texts.read() if b is None else texts.read().where(F.col("doc_id") < b)
        one = index.ingest(batch, store, a)
        found = one if found is None else found.unionByName(one)
    index.drop()
    kept = remove(texts.read(), found, with_text)
    return kept.unionByName(remove(docs.where("doc_id is null"), found.limit(0), with_text))


#: For small tables: every window as text.
ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT rid, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50 AND doc_id IS NOT NULL)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM win JOIN firsts USING (h) WHERE doc_id > first_doc),
each AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN cut USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (rid)
"""
