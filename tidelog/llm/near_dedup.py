"""MinHash near-deduplication with DartMinHash signatures.

Weighted darts: the plane over an element, weight by rank, is split into unit cells;
each cell holds a Poisson(1) number of darts, all made from hashes of (element, cell),
so every document sees the same darts. A dart counts if its weight coordinate lies
below the element's weight. It falls on one of k coordinates, which keeps its earliest
dart (least rank). About k ln k + 2k darts a document fill all coordinates, however many
elements it has, so a signature costs O(weight + k log k); a document with an empty
coordinate looks at twice as many ranks, until it has none. Two coordinates agree with a probability of
the weighted Jaccard similarity (sum of least by sum of largest weights). Bands of r
coordinates are the keys of candidates. Weights are how often a shingle occurs, so the
similarity is that of the sets of (shingle, 1st, 2nd, ... occurrence), which is what
sizes, parity bitmaps and the exact comparison use. ``weighted=False``: all weights are 1.

Documents with equal shingles collapse first. Candidate pairs within a band bucket
are never all emitted: in a round, each bucket offers a few representatives, from its
smallest components, one for each salt; the others of different components are compared
with them by the exact similarity of the sets, links contract components, and the
representatives leave the bucket. The bucket's largest component offers none: when the
others have been compared with everything, the bucket is done. A comparison that can't
reach the similarity leaves no row: sizes bound it, and so does the parity bitmap of each
set (an element flips a bit): the bits in which two bitmaps differ are no more than the
elements in which the sets do. A bitmap is as wide as its set is large, as a full one tells
nothing: all sets have one of 512 bits, larger ones also one of a bit or two for each element
and one of half that width, so that sets of similar sizes have a width in common. Rounds go on until no bucket holds two components, so
every candidate pair is compared, is excluded by a bound, or is connected already.

Defined results: a document without words (null, empty, blank) is a class of its own; a
text of fewer than ``k_words`` words has one shingle, of all its words; rows that share a
doc_id are one document (of different texts the one with the least sums of shingle hashes
counts); a null doc_id is left out of the classes and returned with a null class.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import U, mix, shingle_sets

K_WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 7
#: Representatives that a bucket offers at most in the first and in each later round.
OFFERS = (4, 4096)
#: Up to so many links (16 bytes each) are connected in one task; more by propagation.
TASK_LINKS = 500_000
#: 64-bit words of the parity bitmap that all sets have.
BITMAP = 8
#: Cells of darts that are made at once.
CELLS = 1 << 18

#: Two sums of salted hashes tell sets apart.
SALT_1, SALT_2 = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Ranks fit 16 bits. A weight of 1 has about 65,000 darts by then: an empty coordinate is out of the question.
MAX_RANK = 1 << 16
_LOW = U(0xFFFFFFFF)
#: Poisson(1): below CDF[n], as a share of 2**64, there are at most n darts.
_CDF = np.array([min(2**64 - 1, int(sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) * 2**64)) for n in range(18)], dtype=U)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) signatures of weighted sets; documents without elements get the largest value."""
    n_docs = len(offsets) - 1
    sig = np.full((n_docs, k), U(2**64 - 1), U)
    total = np.zeros(n_docs)
    size = np.diff(offsets)
    np.add.at(total, np.repeat(np.arange(n_docs), size), weights)
    ranks = np.ceil((k * math.log(k) + 2 * k) / np.maximum(total, 1e-9)).astype(np.int64)
    todo, begin = np.flatnonzero(size > 0), np.zeros(n_docs, np.int64)
    while len(todo):
        # elements of the documents still open, one entry for each unit of weight begun
        el = np.repeat(offsets[todo] - np.concatenate([[0], np.cumsum(size[todo])[:-1]]), size[todo]) + np.arange(size[todo].sum())
        doc = np.repeat(todo, size[todo])
        units = np.maximum(1, np.ceil(weights[el]).astype(np.int64))
        unit = np.arange(units.sum()) - np.repeat(np.concatenate([[0], np.cumsum(units)[:-1]]), units)
        el, doc = np.repeat(el, units), np.repeat(doc, units)
        base = mix(elements[el] + unit.astype(U) * U(0x9E3779B97F4A7C15))
        left = weights[el] - unit
        reps = ranks[doc] - begin[doc]
        ends = np.cumsum(reps)
        lo = 0
        while lo < len(base):  # about CELLS cells at a time: bounds the memory whatever the lengths
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
            part, lo = slice(lo, hi), hi
            times = reps[part]
            cell_doc, cell_left = np.repeat(doc[part], times), np.repeat(left[part], times)
            rank = np.arange(times.sum()) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times) + begin[cell_doc]
            cell = mix(np.repeat(base[part], times) ^ (rank.astype(U) * U(0xC2B2AE3D27D4EB4F)))
            darts = np.searchsorted(_CDF, cell, "right")
            dart = np.repeat(cell, darts) + (np.arange(darts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(darts)[:-1]]), darts) + 1).astype(U) * U(0xD6E8FEB86659FD93)
            dart = mix(dart)
            spot = mix(dart ^ U(0xA5A5A5A5A5A5A5A5))
            at = (dart >> U(32)) * U(k) >> U(32)
            # value: 16 bits of rank, 16 bits below the point, then 32 bits of identity
            value = (np.repeat(rank, darts).astype(U) << U(48)) | ((spot >> U(48)) << U(32)) | (dart & _LOW)
            hit = (spot & _LOW).astype(np.float64) / 2**32 < np.repeat(cell_left, darts)
            np.minimum.at(sig.reshape(-1), np.repeat(cell_doc, darts)[hit] * k + at[hit].astype(np.int64), value[hit])
        begin[todo] = ranks[todo]
        ranks[todo] *= 2
        todo = todo[(sig[todo] == U(2**64 - 1)).any(axis=1) & (ranks[todo] <= MAX_RANK)]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), U)
    for b in range(bands):
        h = np.full(len(sig), U(b + 1), U)
        for r in range(rows):
            h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out


def occurrences(value: np.ndarray, times: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (element, 1st, 2nd, ... occurrence) and their len+1 offsets."""
    ends = np.concatenate([[0], np.cumsum(times)]).astype(np.int64)
    nth = np.arange(ends[-1]) - np.repeat(ends[:-1], times)
    out = np.repeat(value, times)
    more = nth > 0
    out[more] = mix(out[more] ^ mix(nth[more].astype(U) * U(0x9E3779B97F4A7C15)))
    return out, ends[off]


def parity(value: np.ndarray, off: np.ndarray, sets: np.ndarray, width: int) -> np.ndarray:
    """(sets, width / 64) longs: the parity bitmaps of some of the sets, ``width`` bits (a power of two) each."""
    size = off[sets + 1] - off[sets]
    ends = np.cumsum(size)
    at = np.repeat(off[sets] - (ends - size), size) + np.arange(size.sum())
    spot = (mix(value[at] ^ U(0x452821E638D01377)) % U(width)).astype(np.int64)
    flips = np.bincount(np.repeat(np.arange(len(sets)), size) * width + spot, minlength=len(sets) * width) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, 8), axis=1).reshape(-1).view(np.int64).reshape(-1, width // 64)


def wide_parity(value: np.ndarray, off: np.ndarray, sets: np.ndarray, halves: int) -> pa.ListArray:
    """Bitmaps as wide as the next power of two from the set's size, over 2**halves; empty where the
    one of BITMAP words is no narrower."""
    size = off[sets + 1] - off[sets]
    width = np.array([1 << max(0, int(n) - 1).bit_length() >> halves for n in size], np.int64)
    width[width <= 64 * BITMAP] = 0
    ends = np.concatenate([[0], np.cumsum(width // 64)])
    out = np.zeros(ends[-1], np.int64)
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        out[ends[some][:, None] + np.arange(w // 64)] = parity(value, off, sets[some], int(w))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def _signatures(k_words: int, bands: int, rows: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            value, times, off = shingle_sets(b.column("text"), k_words)
            times = times if weighted else np.ones(len(value), np.int64)
            keep = np.flatnonzero(np.diff(off) > 0)
            keys = band_keys(dart_signatures(value, times.astype(float), off, bands * rows), bands, rows)[keep]
            value, off = occurrences(value, times, off)
            n = np.diff(off)
            sums = []
            for salt in (SALT_1, SALT_2):
                run_sum = np.zeros(len(value) + 1, U)
                np.cumsum(mix(value ^ salt), out=run_sum[1:])
                sums.append(run_sum[off[1:]] - run_sum[off[:-1]])
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[keep]
            bits = parity(value, off, keep, 64 * BITMAP).reshape(-1)
            maps = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(keep) + 1) * BITMAP, BITMAP, dtype=np.int32)), pa.array(bits))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(keep) + 1) * bands, bands, dtype=np.int32)), pa.array(common.as_long(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(common.as_long(sums[0][keep])), pa.array(common.as_long(sums[1][keep])), pa.array(n[keep].astype(np.int64)), lists, maps, wide_parity(value, off, keep, 0), wide_parity(value, off, keep, 1)], names=["doc_id", "s1", "s2", "n", "keys", "bits", "wide", "half"])

    return run


def _sets(k_words: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            value, times, off = shingle_sets(b.column("text"), k_words)
            value, off = occurrences(value, times if weighted else np.ones(len(value), np.int64), off)
            sums = np.zeros(len(value) + 1, U)
            np.cumsum(mix(value ^ SALT_1), out=sums[1:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(common.as_long(sums[off[1:]] - sums[off[:-1]])), pa.array([value[a:z].tobytes() for a, z in zip(off, off[1:])], pa.binary())], names=["doc_id", "s1", "elements"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) to (a, b, s): the exact Jaccard similarity of the sets x and y."""
    for b in batches:
        out = np.empty(b.num_rows)
        for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
            both = np.concatenate([np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)])
            both.sort()
            n = int((both[1:] == both[:-1]).sum())
            out[i] = n / max(1, len(both) - n)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out)], names=["a", "b", "s"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded number of links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, comp): the smallest node connected with each node of ``edges`` (a stored table).
    Few links, as counted, are one task's; more are connected by least-label propagation with
    pointer jumping. Either way links and labels stay tables; nothing goes to the driver."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    if edges.count() <= task_links:
        return common.stored(edges.coalesce(1).mapInArrow(_connect, "node long, comp long"), "labels")
    both = common.stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = common.stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", "comp", F.least("comp", "l").alias("to"))
        jump = step.select(F.col("node").alias("k"), F.col("to").alias("far"))
        after = common.stored(step.join(jump, step["to"] == jump["k"], "left").select("node", (F.least("to", F.coalesce("far", "to"))).alias("new"), "comp"), "labels")
        if after.where("new <> comp").isEmpty():
            return after.select("node", F.col("new").alias("comp"))
        labels = after.select("node", F.col("new").alias("comp"))


def merged(comp: DataFrame | None, links: DataFrame, rows: int) -> DataFrame:
    """(node, comp) after ``links`` have connected nodes; only the links' components are looked at."""
    if comp is None:
        return components(links)
    of = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_comp", "a").alias("x"), F.coalesce("b_comp", "b").alias("y"))
    edges = common.stored(edges, "contracted", rows)
    nodes = comp.unionByName(edges.select(F.col("a").alias("node"), F.col("x").alias("comp"))).unionByName(edges.select(F.col("b").alias("node"), F.col("y").alias("comp"))).distinct()
    far = components(edges.where("x <> y"), "x", "y").select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    return common.stored(nodes.join(far, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), "components", rows)


def _mark(key: Column) -> Column:
    """31 bits of a bucket's key."""
    return key.bitwiseAND(0x7FFFFFFF).cast("int")


def _wide_apart() -> Column:
    """The bits in which the bitmaps of the widest common width differ; 0 where none but the least is common."""
    x = F.when(F.size("wide") <= F.size("hub_wide"), F.col("wide")).otherwise(F.col("half"))
    y = F.when(F.size("hub_wide") <= F.size("wide"), F.col("hub_wide")).otherwise(F.col("hub_half"))
    bits = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))  # null beyond the shorter one
    return F.coalesce(F.aggregate(bits, F.lit(0), lambda n, m: n + m), F.lit(0))


def near_duplicates(docs: DataFrame, k_words: int = K_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True, offers: Sequence[int] = OFFERS) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id that links of at least
    ``similarity`` connect with the document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.stored(ids.where("doc_id is not null").mapInArrow(_signatures(k_words, bands, rows, weighted), "doc_id long, s1 long, s2 long, n long, keys array<long>, bits array<long>, wide array<long>, half array<long>"), "signatures")
    one = signed.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("s"), F.count(F.lit(1)).alias("rows")).select("doc_id", "s.*", "rows")
    one = common.stored(one, "documents")
    n_docs = one.count()
    rep = common.stored(one.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "sets")
    # both sides are stored, so that a set that a third of all documents share can be many tasks
    members = common.stored(one.select("doc_id", "s1", "s2", "n").join(rep, ["s1", "s2", "n"]).select("doc_id", "rep"), "members", n_docs)
    own = signed.join(rep.withColumnRenamed("rep", "doc_id"), ["doc_id", "s1", "s2", "n"], "left_semi").withColumnRenamed("doc_id", "rep")
    own = common.stored(own, "representatives", n_docs)
    keyed = own.select("rep", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    bitmaps = own.groupBy("rep").agg(*[F.first(F.col("bits")[i]).alias(f"b{i}") for i in range(BITMAP)], F.first("wide").alias("wide"), F.first("half").alias("half"), F.first(F.transform("keys", _mark)).alias("marks"))
    bucket = common.stored(keyed.join(shared, "key").distinct().join(bitmaps, "rep"), "buckets", 8 * n_docs)
    comp, size = None, bucket.count()
    involved = bucket.select(F.col("rep").alias("doc_id")).distinct()
    sets = common.keep_keys(ids.where("doc_id is not null"), involved, "doc_id", size)
    sets = sets.mapInArrow(_sets(k_words, weighted), "doc_id long, s1 long, elements binary")
    if not one.where("rows > 1").isEmpty():
        sets = sets.join(rep.select(F.col("rep").alias("doc_id"), "s1"), ["doc_id", "s1"], "left_semi").groupBy("doc_id").agg(F.first("elements").alias("elements"))
    sets = common.stored(sets.select("doc_id", "elements"), "elements", size)
    bits, wide = [f"b{i}" for i in range(BITMAP)], ["wide", "half"]
    carried = [*bits, *wide, "marks"]
    for turn in itertools.count():
        at = bucket.withColumn("comp", F.col("rep")) if comp is None else bucket.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        sized = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        open_ = sized.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("m", "comp"))["comp"].alias("largest")).where("c > 1").drop("c")
        at = common.stored(at.join(open_, "key").join(sized, ["key", "comp"]), "open", size)
        if at.isEmpty():
            break
        slot = F.pmod(F.xxhash64("rep"), F.lit(offers[min(turn, len(offers) - 1)]))
        offered = at.where("comp <> largest").groupBy("key", slot.alias("slot")).agg(F.min(F.struct("m", F.xxhash64("rep").alias("h"), "rep", "comp", "n", *bits, *wide)).alias("o"))
        offered = common.stored(offered.select("key", F.col("o.rep").alias("hub"), F.col("o.comp").alias("hub_comp"), F.col("o.n").alias("hub_n"), *[F.col(f"o.{x}").alias(f"hub_{x}") for x in [*bits, *wide]]), "offered", size)
        # a pair is compared once a round, in the least of the buckets that offer the one and hold the other
        everywhere = offered.groupBy("hub").agg(F.collect_set(_mark(F.col("key"))).alias("hub_marks"))
        once = _mark(F.col("key")) == F.array_min(F.array_intersect("marks", "hub_marks"))
        # |x - y| + |y - x| <= (1 - s) / (1 + s) * (|x| + |y|) for a similarity of at least s
        apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"hub_{x}"))) for x in bits[1:]), F.bit_count(F.col(bits[0]).bitwiseXOR(F.col(f"hub_{bits[0]}"))))
        most = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("hub_n")) + 1e-6
        near = (F.col("comp") != F.col("hub_comp")) & (F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")) & (apart <= most) & once & (_wide_apart() <= most)
        pairs = at.join(offered.join(everywhere, "hub"), "key").where(near).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        checked = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
        compared = common.stored(checked.mapInArrow(_verify, "a long, b long, s double"), "compared", size)
        links = compared.where(F.col("s") >= similarity - 1e-12).select("a", "b")
        bucket = common.stored(at.select("key", "rep", "n", *carried).join(offered.select("key", F.col("hub").alias("rep")), ["key", "rep"], "left_anti"), "buckets", size)
        if not links.isEmpty():
            comp = merged(comp, links, size)
    classes = members
    if comp is not None:
        classes = members.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("class_id"))
    else:
        classes = members.select("doc_id", F.col("rep").alias("class_id"))
    return ids.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


#: For small tables: all pairs that share a shingle; doc_ids are unique there.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
counted AS (SELECT doc_id, md5(s) AS s, count(*) AS n FROM shingled GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS n FROM counted GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common
  FROM counted a JOIN counted b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM documents d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
