"""Toxicity by weak supervision.

Voters: lexicons, patterns, and lexicons mined from labelled training rows (terms and
stems by their share of toxic documents), each present or absent in a document. A generative label
model over the counts of vote patterns of *all* documents (at most 2**voters) estimates
by expectation-maximisation the class balance, each voter's accuracies and, from what
correlation is left within the classes, joint tables for groups of correlated voters;
training labels hold the class of their documents. The posterior labels train a sparse
linear classifier on hashed terms and stems, which scores every whole text.

Bound: the classifier is fitted on ``FIT_ROWS`` different rows (doc_id and text) of either
posterior class, by smallest hash of doc_id, and of these on as many as hold ``FIT_FEATURES``
features together. One executor's task fits it, within these bounds; what comes to the
driver are its weights (2**BITS at most), the counts of vote patterns (3 * 2**voters at most)
and the mined terms: each is in 1 / support toxic training texts at least, so there are no more
than the mean number of different terms of a toxic text, divided by ``support``. Mined
lexicons cover all labelled training rows; votes, their counts, and scores cover all rows. Only rows with crc32(doc_id as text) mod 3
other than 1 give labels or are fitted on. Labels, language, source and id are no input
of a score.

Defined results: an empty or null text gets the classifier's bias as its score; without
labels or without any positive vote the classifier is its bias alone, score below the
threshold; several labels of one doc_id count as their majority; rows that share a
doc_id are scored each; a null doc_id is scored and not held out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import U, Words, mix, term_hash

THRESHOLD = 0.7
FIT_ROWS, FIT_FEATURES, BITS = 4_000, 6_000_000, 20
#: Bytes of a term's stems: insults inflect.
STEMS = (4, 5)
#: The voters' lexicons.
LEXICONS = {
    "intellect": ["idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "imbecile", "dumb", "dumbass", "dimwit", "halfwit", "fool", "cretin", "retard", "retarded", "brainless"],
    "worth": ["worthless", "loser", "losers", "pathetic", "useless", "nobody", "failure", "waste"],
    "disgust": ["scum", "scumbag", "trash", "garbage", "filth", "filthy", "vermin", "disgusting", "vile", "repulsive", "gross"],
    "ridicule": ["clown", "clowns", "joke", "laughable", "ridiculous", "crybaby", "coward", "creep", "freak", "weirdo"],
    "abuse": ["bastard", "bitch", "asshole", "jerk", "pig", "swine", "crap", "damn", "hell", "shit", "fuck", "fucking", "slut", "whore"],
    "threat": ["kill", "die", "hate", "hurt", "destroy", "burn", "punch", "hang"],
}
MINED = 3
VOTERS = [*LEXICONS, "repeated_insult", "shouting", *[f"mined_{i}" for i in range(MINED)]]


def training(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0)) != 1


def _terms(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of all terms and of their stems, the document of each, and the terms."""
    words = Words(b.column("text"), terms=True)
    h, doc = words.hashes(STEMS), np.repeat(np.arange(b.num_rows), words.count)
    there = h != 0
    there[0] = True
    return h[there], np.broadcast_to(doc, h.shape)[there], words


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


# --- lexicon mining -------------------------------------------------------------------


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per step: (term, documents, toxic documents), already summed."""
    for b in common.steps(batches):
        h, doc, _ = _terms(b)
        h, doc = _distinct(h, doc)
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)[doc]
        term, at = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(common.as_long(term)), pa.array(np.bincount(at, minlength=len(term)).astype(np.int64)), pa.array(np.bincount(at, weights=toxic, minlength=len(term)).astype(np.int64))], names=["term", "n", "n_toxic"])


def mine(labelled: DataFrame, precision: float = 0.9, support: float = 0.01) -> list[np.ndarray]:
    """Sorted term hashes of each mined voter. ``labelled``: (doc_id, text, toxic)."""
    labelled = labelled.dropDuplicates(["text"])  # a text's copies say no more than the text
    terms = labelled.mapInArrow(_term_counts, "term long, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    positives = labelled.agg(F.sum("toxic")).first()[0] or 0
    found = terms.where((F.col("n_toxic") >= max(5, support * positives)) & (F.col("n_toxic") >= precision * (F.col("n") + 1))).select("term").collect()
    h = np.sort(np.array([r[0] for r in found], np.int64).view(U))
    return [h[mix(h) % U(MINED) == U(i)] for i in range(MINED)]


# --- votes ----------------------------------------------------------------------------


def _within(sorted_set: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[at] == h


def votes_of(b: pa.RecordBatch, lexicons: list[np.ndarray], n_fixed: int) -> np.ndarray:
    """A bit for each voter, in the order of VOTERS."""
    h, doc, words = _terms(b)
    out = np.zeros(b.num_rows, np.int64)
    insults = np.zeros(b.num_rows, np.int64)
    for i, lexicon in enumerate(lexicons):
        hits = np.bincount(doc[_within(lexicon, h)], minlength=b.num_rows)
        if i < n_fixed:
            insults += hits
        out |= (hits > 0).astype(np.int64) << (i if i < n_fixed else i + 2)
    out |= (insults >= 3).astype(np.int64) << n_fixed
    raw = words.data if not len(words.data) else np.frombuffer(b"".join((t or "").encode() for t in b.column("text").to_pylist()), np.uint8)
    marks = np.concatenate([[0], np.cumsum(raw == 33)])
    loud = (marks[words.off[1:]] - marks[words.off[:-1]]) >= 3
    return out | (loud.astype(np.int64) << (n_fixed + 1))


def _votes(lexicons: list[np.ndarray], n_fixed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(votes_of(b, lexicons, n_fixed))], names=["doc_id", "tkey", "votes"])

    return run


# --- label model ----------------------------------------------------------------------


class LabelModel:
    """p(toxic | votes) from counts of vote patterns, some with a known class."""

    def __init__(self, n_voters: int, correlated: float = 0.25, group: int = 3, rounds: int = 40):
        self.n, self.correlated, self.group, self.rounds = n_voters, correlated, group, rounds
        self.groups = [[i] for i in range(n_voters)]

    def _states(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(((votes >> v) & 1) << j for j, v in enumerate(g)) for g in self.groups]

    def _em(self, votes: np.ndarray, count: np.ndarray, known: np.ndarray, post: np.ndarray) -> np.ndarray:
        for _ in range(self.rounds):
            weight = np.stack([count * (1 - post), count * post])
            self.prior = float((weight[1].sum() + 0.5) / (weight.sum() + 10))
            odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
            self.tables = []
            for g, state in zip(self.groups, self._states(votes)):
                size = 1 << len(g)
                t = np.stack([np.bincount(state, weights=w, minlength=size) + 0.2 for w in weight])
                t /= t.sum(axis=1, keepdims=True)
                self.tables.append(t)
                odds += np.log(t[1][state]) - np.log(t[0][state])
            new = np.where(known >= 0, known, 1 / (1 + np.exp(-np.clip(odds, -40, 40))))
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return post

    def fit(self, votes: np.ndarray, count: np.ndarray, known: np.ndarray) -> LabelModel:
        """``known``: the class of the pattern's documents, or -1."""
        bits = np.stack([(votes >> v) & 1 for v in range(self.n)]).astype(float)
        start = np.where(known >= 0, known, np.clip(0.02 + 0.45 * bits.sum(axis=0), 0, 0.98))
        post = self._em(votes, count, known, start)
        left = []
        for i, j in itertools.combinations(range(self.n), 2):  # correlation that the classes don't explain
            cov = var_i = var_j = 0.0
            for w in (count * (1 - post), count * post):
                total = max(w.sum(), 1e-9)
                p, q = (w * bits[i]).sum() / total, (w * bits[j]).sum() / total
                cov += (w * (bits[i] - p) * (bits[j] - q)).sum()
                var_i += (w * (bits[i] - p) ** 2).sum()
                var_j += (w * (bits[j] - q) ** 2).sum()
            left.append((abs(cov) / max(np.sqrt(var_i * var_j), 1e-9), i, j))
        self.correlations = sorted(left, reverse=True)
        of = {v: [v] for v in range(self.n)}
        for c, i, j in self.correlations:
            if c >= self.correlated and of[i] is not of[j] and len(of[i]) + len(of[j]) <= self.group:
                both = of[i] + of[j]
                for v in both:
                    of[v] = both
        self.groups = [sorted(g) for v, g in sorted(of.items()) if min(g) == v]
        self._em(votes, count, known, post)
        return self

    def accuracies(self) -> np.ndarray:
        """(voters, 2): how often each voter fires in either class."""
        out = np.zeros((self.n, 2))
        for g, t in zip(self.groups, self.tables):
            for j, v in enumerate(g):
                fires = (np.arange(t.shape[1]) >> j) & 1 == 1
                out[v] = t[:, fires].sum(axis=1)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for state, t in zip(self._states(votes), self.tables):
            odds += np.log(t[1][state]) - np.log(t[0][state])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


# --- classifier -----------------------------------------------------------------------


def features(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, document) pairs, by document."""
    key = np.unique(doc.astype(np.int64) << BITS | (h >> U(64 - BITS)).astype(np.int64))
    return key & ((1 << BITS) - 1), key >> BITS


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.steps(batches):
        h, doc, _ = _terms(b)
        f, d = features(h, doc)
        cut = np.searchsorted(d, np.arange(b.num_rows + 1))
        f = f.astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), b.column("votes"), pa.array([f[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "tkey", "votes", "features"])


def fit_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, l1: float = 2e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Sparse logistic regression (proximal Adam on all rows); weights and bias."""
    w, prior = np.zeros(1 << BITS), float(np.clip((target * weight).sum() / max(weight.sum(), 1e-9), 1e-3, 0.5))
    bias = np.log(prior / (1 - prior))
    if not len(rows) or not (target > 0.5).any():
        return w, min(bias, -3.0)
    f = np.concatenate(rows)
    # a feature of fewer than three documents can only memorise them
    seen = np.bincount(f, minlength=1 << BITS)
    used, number = np.flatnonzero(seen >= 3), np.zeros(1 << BITS, np.intp)
    number[used] = np.arange(len(used))
    keep = seen[f] >= 3
    row = np.repeat(np.arange(len(rows), dtype=np.intp), [len(r) for r in rows])[keep]
    f = number[f[keep]]
    del keep, number
    v, m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    v[-1] = bias
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=v[f], minlength=len(rows)) + v[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(f, weights=g[row], minlength=len(used)), g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        rate = 0.3 / (np.sqrt(s / (1 - 0.99**step)) + 1e-4)
        v -= rate * m / (1 - 0.9**step)
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - rate[:-1] * l1, 0)
    a, b = _calibrated(np.bincount(row, weights=v[f], minlength=len(rows)) + v[-1], target, weight)
    w[used] = a * v[:-1]
    return w, float(a * v[-1] + b)


def _fit(likely: dict[int, float], share: list[int], max_features: int):
    """One task's rows (votes, features), in their order, to the weights: (feature, weight), the bias as feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target, held = [], [], 0
        for b in batches:
            for votes, f in zip(b.column("votes").to_pylist(), b.column("features")):
                f = np.frombuffer(f.as_buffer(), np.int32)
                if held + len(f) <= max_features:
                    rows.append(f.copy())
                    target.append(likely[votes])
                    held += len(f)
        target = np.array(target, float)
        count = [max(1, int((target <= 0.5).sum())), max(1, int((target > 0.5).sum()))]
        weight = np.where(target > 0.5, share[1] / count[1], share[0] / count[0])
        weight = np.maximum(weight, weight.sum() / max(len(rows), 1) * 0.2)  # a rare class still counts
        w, bias = fit_linear(rows, target, weight)
        live = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, live), pa.int64()), pa.array(np.append(bias, w[live]))], names=["feature", "weight"])

    return run


def _calibrated(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the margins: the sparsity's shrinkage is undone by a factor of two, and
    the threshold score falls into the widest gap of margins with the fewest errors."""
    order = np.argsort(z)
    z, toxic, weight = z[order], target[order] > 0.5, weight[order]
    wrong = np.cumsum(weight * np.where(toxic, 1.0, -1.0))[:-1]  # of a cut above each margin, but for a constant
    best = np.flatnonzero(wrong <= wrong.min(initial=0.0) + 1e-12)
    if not len(best):
        return 1.0, 0.0
    at = best[np.argmax(np.diff(z)[best])]
    cut = (z[at] + z[at + 1]) / 2
    return 2.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - 2.0 * cut)


def _score(w: np.ndarray, bias: float):
    live = np.flatnonzero(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BITS)
        full[live] = w[live]
        for b in common.steps(batches):
            h, doc, _ = _terms(b)
            some = full[(h >> U(64 - BITS)).astype(np.int64)] != 0
            f, d = features(h[some], doc[some])
            z = np.bincount(d, weights=full[f], minlength=b.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> tuple[np.ndarray, float, LabelModel]:
    """The classifier's weights and bias, and the label model."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))
    known = labels.where(training("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("long").alias("toxic"))
    known = common.stored(known, "labels")
    few = known.count() <= common.BROADCAST_KEYS // 2  # two longs a row
    labelled = common.stored(texts.drop("tkey").join(F.broadcast(known) if few else known, "doc_id"), "labelled")
    lexicons = [term_hash(words) for words in LEXICONS.values()] + mine(labelled)
    voted = common.stored(texts.mapInArrow(_votes(lexicons, len(LEXICONS)), "doc_id long, tkey long, votes long"), "votes")
    table = voted.join(known, "doc_id", "left").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 * 2**voters rows
    model = LabelModel(len(VOTERS))
    if not table:
        return np.zeros(1 << BITS), -3.0, model
    model.fit(np.array([r["votes"] for r in table]), np.array([float(r["n"]) for r in table]), np.array([-1 if r["toxic"] is None else r["toxic"] for r in table], float))
    patterns = np.unique([r["votes"] for r in table])
    likely = {int(p): float(q) for p, q in zip(patterns, model.posterior(patterns))}
    sides = [[p for p, q in likely.items() if (q > 0.5) == side] for side in (False, True)]
    mine_side = lambda side: voted.where(training("doc_id") & F.col("doc_id").isNotNull() & F.col("votes").isin(sides[side]))
    chosen, share = None, []
    for side in (0, 1):
        one = mine_side(side)
        total = sum(r["n"] for r in table if int(r["votes"]) in set(sides[side]))
        share.append(total)
        one = one.select("doc_id", "tkey", "votes").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "tkey").limit(fit_rows)
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = texts.join(F.broadcast(chosen), ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "votes").mapInArrow(_rows, "doc_id long, tkey long, votes long, features binary")
    rows = rows.dropDuplicates(["doc_id", "tkey"]).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "tkey")  # at most 2 * fit_rows
    weights = common.stored(rows.select("votes", "features").mapInArrow(_fit(likely, share, fit_features), "feature long, weight double"), "weights").collect()
    w, bias = np.zeros(1 << BITS), -3.0
    for r in weights:
        if r["feature"] < 0:
            bias = r["weight"]
        else:
            w[r["feature"]] = r["weight"]
    return w, bias, model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    w, bias, _ = fit(docs, labels, **options)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(w, bias), "doc_id long, score double")
    return scored.select("doc_id", (~training("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _flag(w: np.ndarray, bias: float, threshold: float):
    score = _score(w, bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches):
            s = np.concatenate([x.column("score").to_numpy(zero_copy_only=False) for x in score(iter([b]))])
            yield b.filter(pa.array(s < threshold))

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are."""
    w, bias, _ = fit(docs, labels, **options)
    return docs.mapInArrow(_flag(w, bias, threshold), docs.schema)
