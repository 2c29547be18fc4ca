import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing, pii, sharding

from .helpers import CLASHES, docs, words

# --- mixing ---------------------------------------------------------------------------------


def brute_targets(sizes, weights, most=3):
    """Reshare the excess again and again, as the contract words it."""
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_targets_and_takes(spark):
    rows = [(i, " ".join(words(1 + i * 7 % 40, i)), ["b", "a", "ä", None, "tiny"][0 if i % 3 else i % 5]) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "a"), (901, "", "a"), (902, " ", "empty"), (903, "x " * 5000, "b")]
    df = docs(spark, rows, CLASHES)
    out = [r.asDict() for r in mixing.curriculum(df).collect()]
    assert len(out) == len(rows)
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        largest = max(r["size"] for r in out if r["source"] == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1
    assert sorted(map(str, out)) == sorted(map(str, (r.asDict() for r in mixing.curriculum(df.repartition(7)).collect())))


def test_schedules_that_vary_with_time(spark):
    rows = [(i, "w " * 10, "early" if i % 2 else "late") for i in range(400)]
    knots = spark.createDataFrame([("early", [(0.0, 1.0), (1.0, 0.0)]), ("late", [(0.0, 0.0), (1.0, 1.0)])], f"source string, knots {mixing.KNOTS}")
    out = mixing.in_training_order(mixing.curriculum(docs(spark, rows), knots)).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    quarter = Counter(r.source for r in out if r.position < 0.25)
    assert quarter["early"] / (quarter["early"] + quarter["late"]) == pytest.approx(0.4375 / 0.5, abs=0.03)
    for s in ("early", "late"):  # the median position solves the integral
        at = sorted(r.position for r in out if r.source == s)
        assert at[100] == pytest.approx(1 - 0.5**0.5 if s == "early" else 0.5**0.5, abs=0.02)


def test_mix_repeats_rows_in_order(spark):
    rows = [(i, " ".join(words(20, i)), "big" if i % 10 else "small") for i in range(200)] + [(None, "no id here", "big"), (5, " ".join(words(20, 5)), "big"), (7, None, "big")]
    df = docs(spark, rows, "extra1")
    out = mixing.mix(df).collect()
    assert out[0].asDict().keys() == set(df.columns)
    times = Counter((r.doc_id, r.text) for r in out)
    want = defaultdict(int)
    for r in mixing.curriculum(df).collect():
        want[r.doc_id] += r.copies
    times_of = defaultdict(list)  # the k-th copy of a document has its k-th position
    for r in mixing.in_training_order(mixing.curriculum(df)).collect():
        times_of[r.doc_id].append(r.position)
    parts = [[times_of[r.doc_id].pop(0) for r in part] for part in mixing.mix(df).rdd.glom().collect()]
    in_order = [t for p in parts for t in p]
    assert in_order == sorted(in_order) and sum(map(bool, parts)) > 1 and not any(times_of.values())
    assert {k: sum(v for (i, _), v in times.items() if i == k) for k in want} == dict(want)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.curriculum(docs(spark, [])).count() == 0


def test_native_plans_have_no_python(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    d = docs(spark, [(1, "a@b.cd x", "s")])
    for df in (mixing.curriculum(d), mixing.mix(d), pii.find_pii(d), pii.redact(d)):
        assert not re.search("Python|Arrow|Pandas", plan(df))


# --- sharding -------------------------------------------------------------------------------


def test_shards_round_trip_and_compact(spark, tmp_path):
    rows = [(i, " ".join(words(30, i)), "s") for i in range(500)] + [(1, None, None), (1, "", "s"), (None, "x" * 100_000, "s"), (1, "", "s")]
    df = docs(spark, rows, "shard shard_id shard_file").repartition(8)
    store, version = sharding.shard(df, f"file://{tmp_path}/a", arrivals=3, target_bytes=20_000, fan_in=3, arrival_rows=25)
    key = lambda r: tuple(map(str, (r.doc_id, r.text, r.source, r.shard)))
    back = store.read(version)
    assert Counter(map(key, back.collect())) == Counter(map(key, df.collect()))
    shards = store.shards()
    assert len({s["file"] for s in shards}) == len(shards) and [s["shard_id"] for s in shards] == list(range(len(shards)))
    tiers = Counter(store.tier(s["bytes"]) for s in shards)
    assert all(n < 3 for t, n in tiers.items() if t) and back.select("shard_file").distinct().count() == len(shards)


def test_versions_are_atomic_and_immutable(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/b", fan_in=100)
    first = store.append(docs(spark, [(1, "a")]))
    second = store.append(docs(spark, [(2, "b")]))
    assert (first, second) == (1, 2)
    assert [r.doc_id for r in store.read(first).collect()] == [1] and sorted(r.doc_id for r in store.read().collect()) == [1, 2]
    with pytest.raises(sharding.CommitConflict):
        store.commit([], first)
    assert store.version() == 2
    store.append(docs(spark, []).coalesce(1))
    assert store.read().count() == 2
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, f"file://{tmp_path}/none").read()


def test_columns_of_all_arrivals_are_kept(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/c", fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 7)], "doc_id long, text string, more int"))
    store.append(spark.createDataFrame([(3.5,)], "other double"))
    want = {(1, "a", None, None), (2, "b", 7, None), (None, None, None, 3.5)}
    for _ in range(2):
        assert {(r.doc_id, r.text, r.more, r.other) for r in store.read().collect()} == want
        store.compact()
    assert len(store.shards()) < 3
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert not re.search("Python|Arrow|Pandas", store.read()._jdf.queryExecution().optimizedPlan().toString())


def test_two_writers(spark, tmp_path):
    one, two = (sharding.ShardStore(spark, f"file://{tmp_path}/d", fan_in=2) for _ in range(2))
    one.append(docs(spark, [(1, "a")]).coalesce(1))
    one.append(docs(spark, [(2, "b")]).coalesce(1))
    run = two._write(docs(spark, [(3, "c")]).coalesce(1))  # written, not yet committed
    held = one.read(2)
    one.compact()
    one.vacuum()
    assert sorted(r.doc_id for r in held.collect()) == [1, 2]  # an older version stays readable
    with pytest.raises(sharding.CommitConflict):
        two.commit(run, 1)
    two._commit_on_top(lambda shards, schema: (shards + run, schema))
    assert sorted(r.doc_id for r in one.read().collect()) == [1, 2, 3]
    one.vacuum(older_than=-1)
    assert sorted(r.doc_id for r in one.read().collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        one.read(1).collect()


def test_a_claim_whose_writer_died_is_taken_over(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/e")
    store.append(docs(spark, [(1, "a")]))
    assert store._claim(2) and not store._claim(2)
    with pytest.raises(sharding.CommitConflict):
        store.commit([], 1)
    monkeypatch.setattr(sharding, "STALE_SECONDS", -1)
    assert store.commit([], 1) == 2


def test_sharding_of_nothing(spark, tmp_path):
    store, version = sharding.shard(docs(spark, []), f"file://{tmp_path}/f")
    assert store.read(version).collect() == [] and "shard_id" in store.read(version).columns


# --- personal data --------------------------------------------------------------------------


def brute_base(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and (not 13 <= len(digits) <= 19 or sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PRIVATE = [
    "mail a.b+c@x-y.co.uk, and d@e.f_g@h.i.j; @x.y a@b a@b. a@.b é@b.c 😀 q@w.e", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.4 1.2.3 00000000000000000255.1.1.1 99999999999999999999.1.1.1", "card 4445513251889405 4445-5132-5188-9405 4445 5132 5188 9405, 4445513251889406 1234567890123",
    "+1 (886) 555-9674 zz +12 3 +1 555 +123456789012345678 ++49 30 1234567- +4930.12345.67", "", None, " a@b.cd  1.1.1.1", "7" * 5000 + " " + "a." * 3000 + "@ " + "1 " * 3000, "x@" + "y." * 2000 + "z 9.9.9.9", "é 10.0.0.1\n10.0.0.2\t+1-234-567-8901",
]


def test_base_spans_match_brute_force(spark):
    df = docs(spark, [(i, t) for i, t in enumerate(PRIVATE)] + [(3, PRIVATE[3])], CLASHES)
    for r in pii.spans_text(pii.find_pii(df)).collect():
        want = brute_base(PRIVATE[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_bootstrapping_discovers_unseen_identifiers(spark):
    rows = [(i, f"{words(1, i)[0]} please write to user{i}@mail.org now. Lorem w{i} 12{i} ipsum") for i in range(40)]
    rows += [(100, "please write to jane(at)mail.org now"), (101, "noise here jane99(at)other.org there"), (102, "please write to 5551234 now")]
    out = {r.doc_id: r for r in pii.spans_text(pii.find_pii(docs(spark, rows))).collect()}
    assert all(out[i].spans == brute_base(t) for i, t in rows if i < 100)
    assert out[100].n_email == 0 and out[100].spans == ""  # too short to be a token with a digit or an at sign
    rows[40] = (100, "please write to jane7(at)mail.org now")
    out = {r.doc_id: r for r in pii.spans_text(pii.find_pii(docs(spark, rows))).collect()}
    assert out[100].n_email == 0 and out[100].spans == "email:16:33"
    assert out[101].spans == "" and out[102].spans == ""
    red = {r.doc_id: r for r in pii.redact(docs(spark, rows, "tokens")).collect()}
    assert red[100].text == "please write to [EMAIL] now" and red[100].n_chars == len(red[100].text) and red[100].tokens == "clash"


def test_bootstrapping_of_identifiers_with_spaces(spark):
    phone = lambda i: f"+1 ({200 + i}) 555-{1000 + i}"
    rows = [(i, f"{words(1, i)[0]} call me at {phone(i)}, thanks") for i in range(20)]
    good = [c for c in (f"4445 5132 {i:04d} {j:04d}" for i in range(30) for j in range(10)) if brute_base(c)][:20]
    rows += [(50 + i, f"{words(1, i)[0]} paid with card {c} yesterday") for i, c in enumerate(good)]
    # no base pattern: no plus sign; a wrong check digit
    bad = next(c for c in (f"4445 5132 7777 {j:04d}" for j in range(10)) if not brute_base(c))
    rows += [(100, "please call me at 0487 555 7209, thanks"), (101, f"she paid with card {bad} yesterday"), (102, "lines of 0487 555 7209 numbers")]
    df = docs(spark, rows)
    out = {r.doc_id: r for r in pii.spans_text(pii.find_pii(df)).collect()}
    assert all(out[i].spans == brute_base(t) for i, t in rows if i < 100)
    assert out[100].spans == "phone:18:31" and out[101].spans == "card:19:38" and out[102].spans == ""
    seen = pii._occurrences(pii.scanned(df)).where("row >= 0").collect()
    assert {r.value for r in seen if r.kind} == {phone(i) for i in range(20)} | set(good)
    assert {r.value for r in seen if not r.kind} == {"0487 555 7209", bad}  # no fragments
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[100] == "please call me at [PHONE], thanks" and red[101] == "she paid with card [CARD] yesterday"


def test_occurrences_have_no_limits(spark):
    long = f"{'jane' * 30}7(at)mail.org"
    rows = [(i, f"ref a{i}b1 mail user{i}@mail.org 4you {words(1, i)[0]}") for i in range(20)]
    rows += [(100, f"ref q7q7 mail {long} 4you x"), (101, "one two " + "y" * 200 + " a@b.cd;e@f.gh;i@j.kl;m@n.op;q@r.st;u@v.wx end")]
    rows += [(200 + i, f"reply to2 x9x9 user{i}@mail.org 22nd") for i in range(20)] + [(300, "reply to2 x9x9 joe5(at)mail.org 22nd")]
    df = docs(spark, rows)
    out = {r.doc_id: r.spans for r in pii.spans_text(pii.find_pii(df)).collect()}
    assert out[100] == f"email:14:{14 + len(long)}" and out[300] == "email:15:31"
    seen = pii._occurrences(pii.scanned(df.where("doc_id in (101, 300)"))).collect()
    assert {r.pattern for r in seen if r.value == "joe5(at)mail.org"} == {"L to2 x9x9", "M x9x9 _ 22nd"}
    y = "y" * 200
    assert f"L two {y}" in {r.pattern for r in seen if r.value == "a@b.cd"}
    assert f"L {y} a@b.cd;e@f.gh;i@j.kl;m@n.op;q@r.st;" in {r.pattern for r in seen if r.value == "u@v.wx"}
    assert "M a@b.cd; _ ;i@j.kl;m@n.op;q@r.st;u@v.wx" in {r.pattern for r in seen if r.value == "e@f.gh"}


def test_redaction(spark):
    rows = [(1, "é a@b.cd, 1.2.3.4"), (2, None), (3, "clean"), (4, ""), (1, "é a@b.cd, 1.2.3.4"), (5, "+1 4445513251889405 x")]
    out = sorted(((r.doc_id, r.text) for r in pii.redact(docs(spark, rows)).collect()), key=str)
    assert out == sorted([(1, "é [EMAIL], [IP]"), (1, "é [EMAIL], [IP]"), (2, None), (3, "clean"), (4, ""), (5, "+1 4445513251889405 x" if not brute_base(rows[5][1]) else out[-1][1])], key=str)
    assert pii.redact(docs(spark, [])).count() == 0
    both = spark.range(1).select(pii.redacted(F.lit("0123456789"), F.array(F.struct(F.lit(1).cast("long").alias("start"), F.lit(4).cast("long").alias("end"), F.lit("ip").alias("kind")), F.struct(F.lit(3).cast("long").alias("start"), F.lit(6).cast("long").alias("end"), F.lit("card").alias("kind")))))
    assert both.first()[0] == "0[IP]6789"
