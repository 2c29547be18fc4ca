import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import html_text, impact_topk, packing, prefix_forest, toxicity
from tidelog.llm.queries import default_tokenizer

from .helpers import CLASHES, docs, held_out, words

# --- toxicity -------------------------------------------------------------------------------


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        w = words(40, i, 5000)
        if toxic:
            w[5:5] = ["you", ["idiot", "moron", "zork"][i % 3], ["scum!", "Loser", "zork"][i % 2]]
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    return docs(spark, rows, CLASHES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_hold_out(spark):
    d, lab = labelled(spark)
    out = {r.doc_id: r for r in toxicity.score_toxicity(d, lab).collect()}
    assert len(out) == 600 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in out.values())
    hidden = [r for r in out.values() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in hidden]) > 0.97
    # labels of held-out rows change nothing
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(d, flipped).collect()}
    assert all(again[i] == pytest.approx(r.score) for i, r in out.items())


def test_toxicity_edge_cases(spark):
    d, lab = labelled(spark, 60)
    none = lab.limit(0)
    assert toxicity.score_toxicity(docs(spark, []), none).collect() == []
    odd = d.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x"), (1000, None), (1001, ""), (1001, ""), (1002, "idiot " * 30_000)], "doc_id long, text string"))
    twice = lab.unionByName(lab).unionByName(spark.createDataFrame([(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    out = toxicity.score_toxicity(odd, twice).collect()
    assert len(out) == 65 and {r.predicted for r in out if r.doc_id in (1000, 1001)} == {0}
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs(spark, [(i, "calm words") for i in range(9)]), none).collect())


def test_rejection_keeps_rows_whole(spark):
    d, lab = labelled(spark)
    kept = toxicity.reject_toxic(d, lab)
    assert kept.columns == d.columns
    left = [r.doc_id for r in kept.collect()]
    assert len(left) == len(set(left)) and sum(i % 7 == 0 for i in left) < 5 and sum(i % 7 != 0 for i in left) > 505


def test_lexicons_are_mined_on_all_labelled_rows(spark, monkeypatch):
    class Seen(Exception):
        pass

    def mine(labelled):
        raise Seen(labelled.count())

    monkeypatch.setattr(toxicity, "mine", mine)
    n = 33_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    with pytest.raises(Seen) as seen:
        toxicity.fit(ids.withColumn("text", F.lit("some words")), ids.withColumn("toxic", F.lit(0)))
    assert seen.value.args[0] == sum(not held_out(i) for i in range(n)) > 20_000


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    v = np.stack([rng.random(20_000) < np.where(y, a, b) for a, b in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.03))])
    v = np.vstack([v, np.where(rng.random(20_000) < 0.95, v[0], rng.random(20_000) < 0.5)])  # a copy of the first
    votes = (v.astype(np.int64) << np.arange(4)[:, None]).sum(axis=0)
    known = np.where(np.arange(20_000) < 4000, y, -1)  # a fifth is labelled
    pattern, count = np.unique(votes * 3 + known + 1, return_counts=True)
    m = toxicity.LabelModel(4).fit(pattern // 3, count.astype(float), (pattern % 3 - 1).astype(float))
    assert [0, 3] in m.groups and m.prior == pytest.approx(0.2, abs=0.03)
    assert m.accuracies()[1] == pytest.approx([0.05, 0.7], abs=0.05)
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.93


# --- packing --------------------------------------------------------------------------------


def test_packing(spark):
    rows = [(i, " ".join(words(1 + i * 53 % 900, i))) for i in range(150)] + [(200, None), (201, ""), (202, "long " * 9000), (202, "long " * 9000), (None, "no id"), (203, "a<|endoftext|>b")]
    out = packing.pack(docs(spark, rows, CLASHES), default_tokenizer(), rows_per_salt=20).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        own = sorted(set((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]))
        assert [p[0] for p in own] == list(range(len(own))) and own[0][1] == 0 and sum(p[2] for p in own) == len(ids)
        assert all(n == 2048 for _, _, n, _ in own[1:]) and (len(own) == 1 or len(ids) > 2048)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for _, a, n, c in own)
    assert len(pieces[202]) == 2 * len({r.piece for r in pieces[202]})
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(docs(spark, []), default_tokenizer()).collect() == []


def test_fullest_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = np.zeros(41, np.int64)
        for n in rng.integers(1, 40, 5):
            counts[n] = rng.integers(1, 4)
        sums = {0}
        for n in np.flatnonzero(counts):
            sums = {s + n * k for s in sums for k in range(counts[n] + 1) if s + n * k <= 40}
        got = packing.fullest(counts, 40)
        assert sum(got) == max(sums) and all(got.count(n) <= counts[n] for n in set(got))


def test_plan_uses_every_piece_once():
    counts = np.zeros(2049, np.int64)
    rng = np.random.default_rng(1)
    np.add.at(counts, rng.integers(1, 2049, 5000), 1)
    counts[700] += 30_000  # a hot length
    used = np.zeros_like(counts)
    for bins, each in packing.plan_bins(counts):
        assert sum(n * k for n, k in each) <= 2048
        for n, k in each:
            used[n] += k * bins
    assert (used == counts).all()


def test_encoders_agree():
    e = packing.Encoder(default_tokenizer())
    for t in ("Hello  world\n\n x", "naïve 😀 été 123 don't", "\t tab nbsp", "日本語テキスト", "<|endoftext|> x", "a" * 3000):
        assert e.ids(t).tolist() == e.plain.encode(t, add_special_tokens=False).ids


# --- searches -------------------------------------------------------------------------------


def vectors(spark, x, more=()):
    rows = [(int(i), [float(v) for v in e], 1) for i, e in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(x, ids, q, k, own):
    s = x @ q
    m = ids != own
    at = np.lexsort((ids[m], -s[m]))[:k]
    return [(int(i), float(v)) for i, v in zip(ids[m][at], s[m][at])]


BAD = [(9001, None, 1), (9020, [float("nan")] * 8, 1), (9002, [1.0] * 7 + [float("inf")], 1), (None, [9.0] * 8, 1), (9003, [None] * 8, 1), (9004, [], 1)]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    x[100:160] = x[100]  # ties
    x[300] = 0
    df = vectors(spark, x, [*BAD, (5, [float(v) for v in x[5]], 1)])
    v = np.floor(64 * x.astype(float))
    got = defaultdict(list)
    for r in sorted(impact_topk.top_k(df, block_rows=200).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    for q in got:
        assert got[q] == exact(v, np.arange(900), v[q], 20, q)
    assert impact_topk.top_k(df.limit(0)).collect() == []
    few = impact_topk.top_k(vectors(spark, x[:5])).collect()
    assert len(few) == 4 and impact_topk.top_k(vectors(spark, x[:1])).collect() == []


def test_top_k_with_large_numbers(spark):
    x = np.array([[1e7, -3e6], [2e7, 5.0], [-1e7, 1e7], [1e7, -3e6]])
    got = [(r.vec_id, r.score) for r in impact_topk.top_k(vectors(spark, x)).orderBy("rank").collect()]
    v = np.floor(64 * x.astype(np.float32).astype(float)).astype(object)
    want = sorted(((int((v[i] * v[0]).sum()), -i) for i in (1, 2, 3)), reverse=True)
    assert got == [(-i, s) for s, i in want]


def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((10, 8))
    x = (centres[rng.integers(0, 10, 3000)] + 0.5 * rng.standard_normal((3000, 8))).astype(np.float32)
    x[1000:1100] = x[1000]
    df = vectors(spark, x, [*BAD, (9005, [0.0] * 8, 1), (9006, [0.0] * 8, 1)])
    got = defaultdict(list)
    for r in sorted(prefix_forest.nearest(df, candidates=2000, block_rows=1500).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        want = exact(x.astype(float), np.arange(3000), x[q].astype(float), 20, q)
        assert len(got[q]) == 20 and q not in [i for i, _ in got[q]]
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert all(s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float)), abs=1e-12) for i, s in got[q])
    assert hits >= 0.9 * 20 * 150
    assert [i for i, _ in got[1000]] == list(range(1001, 1021)) or got[1000][0][1] > float(x[1000].astype(float) @ x[1000].astype(float))
    assert prefix_forest.nearest(df.limit(0)).collect() == []


# --- HTML -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div>Site name</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></ul></nav><!-- <p>not this</p> -->
<div class="cookie-banner">We use cookies. <button>OK</button></div>%s
<aside>Related: <a href=x>other</a></aside><section id="comments"><h3>Comments</h3><p>First! What a long and interesting comment this is, really.</p></section>
<form><label>Mail</label><input name=a></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("body,text", [
    ("<article><h1>A &amp; B</h1><p>One   <b>two</b>\n three&nbsp;four.<p>Five &lt;six&gt; <a href=q>seven</a>.</article>", "A & B\nOne two three four.\nFive <six> seven."),
    ("<div id=main><h2>Head</h2><p>Some text that goes on for a while, as articles do.</p><div class=ad>Buy now</div><p>More text of the same article, after an advert.</p></div>", "Head\nSome text that goes on for a while, as articles do.\nMore text of the same article, after an advert."),
    ("<article><p><b>Unclosed bold.<br><p>Next paragraph</article>", "Unclosed bold.\nNext paragraph"),
    ("<main><section><p>Part one of the article is here with words.</p></section><section><p>Part two of the article is here with words.</p></section></main>", "Part one of the article is here with words.\nPart two of the article is here with words."),
    ("<article><ul><li>one thing<li>another thing</ul><table><tr><td>cell a<td>cell b</table></article>", "one thing\nanother thing\ncell a\ncell b"),
    ("<article><p>unfinished <a href='x", "unfinished"), ("", ""),
])
def test_extraction(body, text):
    assert html_text.extract(PAGE % body if not body.endswith("'x") else body) == text


def test_extraction_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text"), (None, "u", "<p>x</p>"), (3, None, "plain text"), (4, "u", "<p>" + "word " * 100_000 + "</p>"), (5, "u", "<div>" * 5000 + "deep" + "</div>" * 5000), (6, "u", "<" * 1000)]
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 8 and got[1].text == "" and got[1].n_chars == 0 and got[2].text == "" and got[3].text == "plain text" and got[None].text == "x"
    assert got[4].n_chars == 499_999 and got[5].text == "deep"
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("attr", ["class=ad", "class='x ads-2'", 'class="cookieNotice"', "id=sidebar", "role=navigation", "class='user-comment first'", "class=header", "hidden", 'aria-hidden="true"', "class=share_buttons", "id=newsletter1"])
def test_boilerplate_by_attribute(attr):
    page = f"<body><div {attr}>Something that is no article, at some length, for good measure.</div><div class=content><p>The article has this text.</p><p>And this.</p></div></body>"
    assert html_text.extract(page) == "The article has this text.\nAnd this."


@pytest.mark.parametrize("attr", ["class=content", "class=reading", "id=adventure", "class='headline story'", "class=download", "hidden-x=1"])
def test_other_attributes_are_article(attr):
    assert html_text.extract(f"<body><div {attr}><p>The article has this text.</p><p>And this.</p></div></body>") == "The article has this text.\nAnd this."


def test_density_prefers_text_to_links():
    page = "<body><div>" + "<a href=x>menu item</a> " * 30 + "</div><div><p>" + "real words in a row " * 20 + "</p><p>" + "and more of them " * 20 + "</p></div></body>"
    assert "menu item" not in html_text.extract(page) and "real words" in html_text.extract(page)


LONG = "".join(f"<p>{'wordy ' * 66}{i}</p>" for i in range(8))
LONG_TEXT = "\n".join(f"{'wordy ' * 66}{i}" for i in range(8))
MENU = "<div>" + "<a href=x>menu item</a> " * 30 + "</div>"


@pytest.mark.parametrize("body,before,after", [
    (f"<article><h1>{'Head ' * 12}</h1><div>{LONG}</div></article>", ("Head " * 12).strip(), ""),
    (f"<article>{'intro ' * 50}<section>{LONG}</section>loose end</article>", ("intro " * 50).strip(), "loose end"),
    (f"<article><div><h1>Head</h1><p>By <a href=j>Jane Doe</a></p></div><div><div>{LONG}</div></div></article>", "Head\nBy Jane Doe", ""),
    (f"<div>{MENU}<h1><a href=x>Head</a></h1>loose <a href=y>and linked</a> text<div>{LONG}</div><p>Caption</p></div>{MENU}", "Head\nloose and linked text", "Caption"),
    (f"<h1>Head</h1><div><div>{LONG}</div></div>{MENU}", "Head", ""),
    (f"<main><h1>Head</h1>{MENU}<div><p>Intro</p><div>{LONG}</div></div></main>", "Head\nIntro", ""),
    (f"<main><h1>Head</h1><article><p>Intro</p><div>{LONG}</div></article></main>", "Head\nIntro", ""),
])
def test_text_beside_the_densest_subtree(body, before, after):
    assert html_text.extract(PAGE % body) == "\n".join(filter(None, [before, LONG_TEXT, after]))


def test_prose_within_an_article_and_unclosed_media():
    page = "<body><article><h1>Market news</h1><p class='share-price'>Shares rose by a tenth.</p>{}<p>They fell again the next day.</p><p class='share'>Tell a friend</p></article></body>"
    want = "Market news\nShares rose by a tenth.\nThey fell again the next day."
    for media in ("<video src=x>", "<video src=x>no player</video>", "<iframe src='a'>", "<object><p>old</p></object>", "<svg><text>axis</text></svg>"):
        assert html_text.extract(page.format(media)) == want
    assert html_text.extract("<body><p>See <a href=http://x/>the page</a> for more.</p><p>Here <math><mi>x</mi></math> is one.</p></body>") == "See the page for more.\nHere x is one."


def test_scores_saturate(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [1e18, 3.0]), (3, [-1e18, 0.0]), (4, [1e308, 1.0]), (5, [2.0**55, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in impact_topk.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (5, 2**63 - 1), (3, -(2**63))]


def test_impact_search_stops_queries_one_by_one():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((3000, 32)) < 0.1, rng.integers(200, 4000, (3000, 32)), rng.integers(-3, 4, (3000, 32)))
    index, q = impact_topk.ImpactIndex(x), x[:40]
    for i, rows, score in index.top(q, 20):
        full = x @ q[i]
        best = np.lexsort((np.arange(3000), -full))[:21]
        assert set(best) <= set(rows) and (score == full[rows]).all()
    stopped = sum(len(rows) > 21 or True for _, rows, _ in index.top(q, 20))
    assert stopped == 40


def test_rows_of_one_doc_id_dont_fill_the_fit(spark, monkeypatch):
    rows = [(1, "calm words") for _ in range(500)] + [(1, f"other {i}") for i in range(40)] + [(i, f"calm text {i}") for i in range(2, 40)]
    d = docs(spark, rows)
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.common.stored
    monkeypatch.setattr(toxicity.common, "stored", lambda df, name, *a: seen.append((name, df)) or real(df, name, *a))
    toxicity.fit(d, lab, fit_rows=10)
    assert "weights" in [n for n, _ in seen]
    target = list(toxicity._fit({0: 0.0, 1: 1.0}, [5, 5], 8)(iter([pa.RecordBatch.from_pydict({"votes": [0, 1, 0], "features": [np.arange(4, dtype=np.int32).tobytes()] * 3})])))
    assert target[0].column("feature").to_pylist()[0] == -1
