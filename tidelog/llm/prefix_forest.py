"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives every vector a long hash string, a bit for each of its random pair
separators (the hyperplane halfway between two sampled vectors, after the inner product
has been made a distance by one more component), and keeps the strings as a sorted
array. A query descends in each tree to its longest-prefix match; then all trees ascend
in step, one prefix bit at a time, until the ranges of rows that share the prefix hold
``candidates`` entries; those rows are scored exactly.

Every row is indexed, in the forest of its block. Separators are drawn from a sample of
at most ``SAMPLE`` rows (smallest hashes of vec_id). Equal vectors are one entry, which
stands for all their ids.

Defined results: see ``op8``; an empty table or one without usable vectors has no rows;
vectors of unequal lengths are filled with zeros; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

TREES, BITS, CANDIDATES, SAMPLE, K = 16, 24, 4500, 2048, 20
RESULT = "query_id long, vec_id long, score double"


def separators(sample: np.ndarray, trees: int, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(trees * bits, dims) directions and their offsets: sign(x @ w - c) is a bit."""
    rng = np.random.default_rng(seed)
    a, b = (sample[rng.integers(0, len(sample), trees * bits)] for _ in range(2))
    w = a - b
    dull = ~w.any(axis=1)
    w[dull] = rng.standard_normal((int(dull.sum()), sample.shape[1]))
    return w, ((a + b) / 2 * w).sum(axis=1)


def strings(x: np.ndarray, w: np.ndarray, c: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, rows) hash strings, the first bit highest."""
    signs = (x @ w.T > c).reshape(len(x), trees, bits)
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2).T


class Forest:
    def __init__(self, rows: np.ndarray, w: np.ndarray, c: np.ndarray, largest: float, trees: int, bits: int):
        self.w, self.c, self.trees, self.bits, self.largest = w, c, trees, bits, largest
        lift = np.sqrt(np.maximum(largest**2 - (rows**2).sum(axis=1), 0))
        h = strings(np.column_stack([rows, lift]), w, c, trees, bits)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the rows that the ascent has met, as index arrays."""
        norm = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        lifted = np.column_stack([queries * (self.largest / np.maximum(norm, 1e-300)), np.zeros(len(queries))])
        h = strings(lifted, self.w, self.c, self.trees, self.bits)
        lo = np.empty((self.bits + 1, self.trees, len(queries)), np.int32)
        hi = np.empty_like(lo)
        for depth in range(self.bits + 1):
            cut = self.bits - depth
            for t in range(self.trees):
                low = h[t] >> cut << cut
                lo[depth, t] = np.searchsorted(self.sorted[t], low)
                hi[depth, t] = np.searchsorted(self.sorted[t], low + (1 << cut))
        met = (hi - lo).sum(axis=1)
        wanted = min(wanted, self.trees * self.sorted.shape[1])
        depth = (met >= wanted).cumsum(axis=0).argmax(axis=0)  # the deepest level with enough entries
        seen = np.zeros(self.sorted.shape[1], bool)
        for q in range(len(queries)):
            seen[:] = False
            for t in range(self.trees):
                seen[self.order[t, lo[depth[q], t, q] : hi[depth[q], t, q]]] = True
            yield q, np.flatnonzero(seen)


def search(w: np.ndarray, c: np.ndarray, largest: float, k: int, candidates: int, trees: int, bits: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            (ids, x), (query_ids, q) = vectors.matrix(rows), vectors.matrix(queries)
            wide = w.shape[1] - 1
            x, q = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (x, q))
            entry, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
            by_entry = np.argsort(of.ravel(), kind="stable")  # ids ascend within an entry
            cut = np.searchsorted(of.ravel()[by_entry], np.arange(len(entry) + 1))
            forest = Forest(entry, w, c, largest, trees, bits)
            for i, met in forest.candidates(q, candidates):
                score = entry[met] @ q[i]
                if len(met) > k + 1:
                    top = np.partition(-score, k)[k]
                    met, score = met[-score <= top], score[-score <= top]
                # of equal vectors only the k + 1 smallest ids can be among the k nearest
                each = [by_entry[cut[e] : min(cut[e + 1], cut[e] + k + 1)] for e in met]
                at, s = np.concatenate(each), np.repeat(score, [len(e) for e in each])
                at, s = at[ids[at] != query_ids[i]], s[ids[at] != query_ids[i]]
                best = np.lexsort((ids[at], -s))[:k]
                out["query_id"].append(np.full(len(best), query_ids[i]))
                out["vec_id"].append(ids[at[best]])
                out["score"].append(s[best])
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, float if n == "score" else np.int64) for n, v in out.items()})

    return run


def nearest(embeddings: DataFrame, k: int = K, every: int = vectors.QUERY_EVERY, trees: int = TREES, bits: int = BITS, candidates: int = CANDIDATES, sample_rows: int = SAMPLE, block_rows: int = vectors.BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product of every query."""
    rows = common.stored(vectors.usable(embeddings, zero=False), "vectors")
    known = rows.agg(F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).alias("largest"), F.max(F.size("embedding")).alias("dims")).first()
    wide, largest = known["dims"] or 1, (known["largest"] or 1.0) * (1 + 1e-12)
    sampled = [r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect()]
    sample = np.zeros((max(1, len(sampled)), wide + 1))
    for i, v in enumerate(sampled):
        sample[i, : len(v)] = v
        sample[i, -1] = np.sqrt(max(largest**2 - float((sample[i] ** 2).sum()), 0))
    w, c = separators(sample, trees, bits)
    return vectors.search_blocks(rows, k, search(w, c, largest, k, candidates, trees, bits), RESULT, every, block_rows)
