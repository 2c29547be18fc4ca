import hashlib
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import near_dedup as nd
from tidelog.llm import substring_dedup as sd
from tidelog.llm.wordhash import Words, shingle_sets, term_hash

from .helpers import CLASHES, docs, words


def brute_substrings(rows, window):
    """Counter of the result's rows; rows may share their doc_id."""
    first, out = {}, Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in split if x[0] is not None), key=lambda x: x[0]):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


def corpus():
    passage, line = words(70, 1), ["same"] * 130
    rows = [(1, " ".join(words(60, 2) + passage + words(40, 3))), (2, " ".join(words(10, 4) + passage[:55] + words(5, 5))), (3, None), (4, ""), (5, " \n\t "), (6, " ".join(passage)), (7, "\x0b".join(passage[5:58])),
            (8, " ".join(line)), (9, "x " + "  ".join(line) + " y"), (10, " ".join(words(49, 2))), (11, " ".join(words(60, 2) + passage + words(40, 3))), (12, " ".join(words(3000, 9) + passage + words(3000, 10))), (13, "é" * 50_000), (20, " ".join(line[:55]))]
    near = words(200, 77)
    for i in range(30):
        w = list(near)
        for j in range(i % 5):
            w[(i * 37 + j * 61) % 200] = f"e{i}_{j}"
        rows.append((100 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("batches,window,anchor", [(1, 50, 16), (2, 50, 16), (5, 50, 16), (3, 8, 3), (2, 6, 6)])
def test_substrings_match_brute_force(spark, batches, window, anchor):
    rows = corpus()
    assert Counter(map(tuple, sd.dedup_substrings(docs(spark, rows, CLASHES), batches, window, anchor).collect())) == brute_substrings(rows, window)


def test_substring_edge_cases(spark):
    assert sd.dedup_substrings(docs(spark, [])).collect() == []
    text = " ".join(words(60, 1))
    out = sd.dedup_substrings(docs(spark, [(None, text), (1, text), (1, text), (2, text)]), with_text=True).collect()
    assert Counter((r.doc_id, r.n_removed) for r in out) == {(None, 0): 1, (1, 0): 2, (2, 60): 1}
    assert {r.kept for r in out if r.doc_id == 1} == {text}


@pytest.mark.parametrize("batches", [1, 3])
def test_rows_that_share_a_doc_id_are_cut_by_their_own_text(spark, batches):
    p, q = " ".join(words(80, 1)), " ".join(words(80, 2))
    rows = [(1, p), (2, p), (2, q), (2, q), (3, q), (3, p + " " + q), (4, words(1, 3)[0] + " " + p), (4, None), (None, p), (5, q + " " + p), (6, p), (6, q)]
    assert Counter(map(tuple, sd.dedup_substrings(docs(spark, rows), batches).collect())) == brute_substrings(rows, 50)


def test_index_is_incremental_and_compacts(spark):
    rows = corpus()
    index = sd.FingerprintIndex(spark, max_runs=2)
    parts = [rows[:6], rows[6:14], rows[14:25], rows[25:]]
    got = Counter()
    for k in range(4):
        seen = [r for p in parts[: k + 1] for r in p]
        found = index.ingest(docs(spark, parts[k]), docs(spark, seen), parts[k][0][0] if k else None)
        got += Counter(map(tuple, sd.remove(docs(spark, parts[k]), found).collect()))
        assert len(index.runs) <= 2
    assert got == brute_substrings(rows, 50)
    assert index._made == 6  # four batches, two compactions
    run = spark.table(index.runs[0])
    plan = run.join(spark.table(index.runs[1]).select("h").hint("merge"), "h", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan  # sorted runs are merged as they lie
    index.drop()


def test_words_are_split_at_ascii_white_space_only(spark):
    import pyarrow as pa

    texts = ["a b\x0cc", "", None, "é x y  z", "q"]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [len((t or "").encode().split()) for t in texts]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [x for t in texts for x in (t or "").encode().split()]
    assert term_hash(["Idiot"]) == term_hash(["idiot"])
    assert Words(pa.array(["you IDIOT! it's"]), terms=True).count.tolist() == [4]


def classes(rows, similarity=0.8, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and (sets[a] & sets[b]).total() >= similarity * (sets[a] | sets[b]).total():
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus() + [(300, "one two"), (301, "one two"), (302, "two one"), (303, "one two three four five six")]
    chain = words(100, 5)
    for i in range(12):  # each link similar to the next, the ends not to one another
        chain = chain[4:] + words(4, 1000 + i)
        rows.append((400 + i, " ".join(chain)))
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, rows, CLASHES)).collect()}
    assert out == classes(rows)


def test_a_large_bucket_takes_several_rounds(spark):
    base = words(150, 3)
    rows = [(i, " ".join(base[: 100 + i % 50] + words(3 + i % 40, i))) for i in range(80)]
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, rows), offers=(1, 2)).collect()}
    assert out == classes(rows)


def test_pairs_of_long_texts_below_the_similarity_are_excluded_unread(spark, monkeypatch):
    base, rows, read = words(1000, 3, 10**6), [], 0
    for i in range(80):  # two groups, each of similar texts; a text and one of the other group are 0.7 similar
        w = list(base)
        w[: 35 * (i % 2) * 5 : 5] = words(35 * (i % 2), 4, 10**6)
        w[700 + 2 * i] = f"e{i}"
        rows.append((i, " ".join(w)))

    def stored(df, name, *rest, f=nd.common.stored):
        nonlocal read
        out = f(df, name, *rest)
        read += out.where("a % 2 <> b % 2").count() if name == "compared" else 0
        return out

    monkeypatch.setattr(nd.common, "stored", stored)
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert out == classes(rows) == {i: i % 2 for i in range(80)}
    assert read < 40  # of 1600 pairs between the groups


def test_bitmaps_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 2**63, 6000).astype(np.uint64)
    off = np.array([0, 0, 500, 1500, 6000])
    sets = np.arange(4)
    assert [len(x) for x in nd.wide_parity(value, off, sets, 0)] == [0, 0, 16, 128]
    assert [len(x) for x in nd.wide_parity(value, off, sets, 1)] == [0, 0, 0, 64]
    a, b = (nd.parity(value, np.array([0, n]), np.arange(1), 1024).view(np.uint64) for n in (1000, 900))
    assert 60 < int(np.bitwise_count(a ^ b).sum()) <= 100


def test_weights_are_counts(spark):
    line, other = words(40, 1), words(40, 2)
    rows = [(1, " ".join(line * 9 + other)), (2, " ".join(line * 2 + other)), (3, " ".join(line * 8 + other)), (4, "a " * 3000), (5, "a " * 2900), (6, "a " * 1000)]
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, rows)).collect()}
    assert out == classes(rows) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}
    plain = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, rows), weighted=False).collect()}
    assert plain[2] == 1 and plain[6] == 4


def test_of_rows_that_share_a_doc_id_one_counts(spark):
    p, q = " ".join(words(80, 1)), " ".join(words(80, 2))
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, [(1, p), (2, p), (2, q), (3, q)])).collect()}
    assert out in ({1: 1, 2: 1, 3: 3}, {1: 1, 2: 2, 3: 2})
    again = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, [(2, q), (3, q), (2, p), (1, p)])).collect()}
    assert again == out


def test_near_duplicate_edge_cases(spark):
    assert nd.near_duplicates(docs(spark, [])).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, None), (5, "")]
    out = Counter((r.doc_id, r.class_id) for r in nd.near_duplicates(docs(spark, rows)).collect())
    assert out == {(None, None): 1, (1, 1): 2, (2, 1): 1, (3, 3): 1, (4, 4): 1, (5, 5): 1}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 6, 300).astype(float)
    v = np.where(rng.random(300) < 0.4, rng.integers(0, 6, 300), w)
    keep = v > 0
    sig = nd.dart_signatures(np.concatenate([e, e[keep]]), np.concatenate([w, v[keep]]), np.array([0, 300, 300 + keep.sum()]), 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05
    one = nd.dart_signatures(e[:1], np.ones(1), np.array([0, 1, 1]), 280)
    assert (one[1] == np.uint64(2**64 - 1)).all() and (one[0] != np.uint64(2**64 - 1)).all()


def test_short_documents_cost_bounded_memory():
    import pyarrow as pa

    value, times, off = shingle_sets(pa.array([f"t{i} u{i}" for i in range(3000)]), 5)
    assert nd.dart_signatures(value, np.ones(len(value)), off, 280).shape == (3000, 280)


@pytest.mark.parametrize("task_links", [0, 1000])
def test_components(spark, task_links):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 60), (70, 60)], "a long, b long")
    got = {r.node: r.comp for r in nd.components(edges, task_links=task_links).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 50: 50, 60: 50, 70: 50}
