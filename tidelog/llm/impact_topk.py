"""Exact top-k search on an impact-ordered, score-at-a-time index.

Vectors are integers, floor(64 * x). A block's index holds for each quantised impact (the
power of two of a component's size) a segment: for each dimension the posting list of the
rows with such a component, and the components. Segments are processed by descending
quantised impact: each posting adds to the scores of its rows, for all queries of a tile
that are still open. After a segment the partial scores A and, for every row, the length r
of what no processed segment holds bound the full score by A - |q| r and A + |q| r
(Cauchy-Schwarz). A row whose upper bound is below the k-th largest lower bound is proved
out. A query that few rows are left for is done: its other segments are skipped, and the
possible members are rescored exactly; a query without that proof processes all segments,
which is exact.

Defined results: an empty table or one without usable vectors has no rows; zero vectors
take part; vectors of unequal lengths are filled with zeros; ties go to the smaller id;
vectors whose 64-fold isn't finite take no part; scores beyond the range of a long count
as its least or largest value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

K, SCALE, TILE = 20, 64, 64
RESULT = "query_id long, vec_id long, score long"


class ImpactIndex:
    """Segments of a block by descending impact: (postings, rest). A posting is (dimension, rows,
    components); ``rest`` is each row's length of what later segments hold."""

    def __init__(self, x: np.ndarray):
        self.x = x
        size = np.abs(x)
        power = np.where(size > 0, np.frexp(size.astype(float))[1], 0)  # size < 2**power
        self.segments = []
        rest = x.astype(float) ** 2
        self.length = np.sqrt(rest.sum(axis=1))
        for p in sorted(set(np.unique(power)) - {0}, reverse=True):
            dim, row = np.nonzero((power == p).T)
            rest[row, dim] = 0
            cut = np.flatnonzero(np.append(True, dim[1:] != dim[:-1]))
            postings = [(int(dim[a]), row[a:z], x[row[a:z], dim[a]]) for a, z in zip(cut, np.append(cut[1:], len(dim)))]
            self.segments.append((postings, np.sqrt(rest.sum(axis=1))))

    def top(self, q: np.ndarray, k: int, few: float = 0.1):
        """(query, rows that may be among its k best, their exact scores) for each query of a tile."""
        reach = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        bound = float(reach.max(initial=0)) * float(self.length.max(initial=0))
        kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64  # exact in either
        n, open_ = len(self.x), np.arange(len(q))
        a, qk = np.zeros((n, len(q)), kind), q.astype(kind)
        for i, (postings, rest) in enumerate(self.segments):
            for dim, row, value in postings:
                a[row] += value.astype(kind)[:, None] * qk[:, dim]
            if i == len(self.segments) - 1 or n <= 4 * k or rest.mean() > 0.3 * self.length.mean():
                continue
            slack = rest[:, None] * reach[None, open_]
            floor = np.partition(a - slack, n - k - 1, axis=0)[n - k - 1]  # k + 1: the query's own row may be one
            maybe = a + slack >= floor - 1e-6 * (1 + np.abs(floor))
            done = maybe.mean(axis=0) <= few
            for j in np.flatnonzero(done):
                yield self._exact(q, open_[j], np.flatnonzero(maybe[:, j]))
            open_, a, qk = open_[~done], np.ascontiguousarray(a[:, ~done]), qk[~done]
            if not len(open_):
                return
        if n > k + 1:
            floor = np.partition(a, n - k - 1, axis=0)[n - k - 1]
        for j, i in enumerate(open_):
            yield self._exact(q, i, np.flatnonzero(a[:, j] >= floor[j]) if n > k + 1 else np.arange(n))

    def _exact(self, q: np.ndarray, i: int, rows: np.ndarray):
        return i, rows, self.x[rows] @ q[i]


class LargeVectors:
    """The same for vectors whose products don't fit a long: all scores, from whole numbers of any size."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def top(self, q: np.ndarray, k: int):
        for i in range(len(q)):
            score = [min(max(int(v), -(2**63)), 2**63 - 1) for v in self.x @ q[i]]
            yield i, np.arange(len(self.x)), np.array(score, np.int64)


def whole_numbers(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, type]:
    """Both as integers, and the index that can take them."""
    x, q = np.floor(SCALE * x), np.floor(SCALE * q)
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(x.shape[1], q.shape[1]) < 2**62 and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2**62:
        return *vectors.fitted(x.astype(np.int64), q.astype(np.int64)), ImpactIndex
    exact = lambda a: np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)
    return *vectors.fitted(exact(x), exact(q)), LargeVectors


def _search(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            (ids, x), (query_ids, q) = vectors.matrix(rows), vectors.matrix(queries)
            x, q, kind = whole_numbers(x, q)
            index = kind(x)
            for lo in range(0, len(q), TILE):
                for i, at, score in index.top(q[lo : lo + TILE], k):
                    own = query_ids[lo + i]
                    at, score = at[ids[at] != own], score[ids[at] != own]
                    best = np.lexsort((ids[at], ~score))[:k]
                    out["query_id"].append(np.full(len(best), own))
                    out["vec_id"].append(ids[at[best]])
                    out["score"].append(score[best])
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()})

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = vectors.QUERY_EVERY, block_rows: int = vectors.BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query."""
    rows = vectors.usable(embeddings, zero=True).where(F.forall("embedding", lambda x: F.abs(x * SCALE) < float("inf")))
    rows = common.stored(rows, "vectors")
    return vectors.search_blocks(rows, k, _search(k), RESULT, every, block_rows)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
