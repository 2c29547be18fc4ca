"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base: four kinds of identifiers by pattern and check (spans in code points). They seed
the bootstrapping: every base span, with the two words to its left and the word to its
right, is an occurrence. So is, where it touches no base span, every identifier-like
token (it holds a digit or an at sign) and every identifier-like run of words (digit
groups; name, at sign, domain) of a kind's loose shape; its fragments are none unless
they have such a shape themselves. Occurrences make
a bipartite graph of lexical patterns (two left words; left and right word) and
instances. Rounds score it: a pattern's confidence for a kind is the share of its
distinct instances that are that kind, by their scores, with one unknown instance
added; an instance's score is the noisy-or of its patterns. Patterns with enough seeds
and a confidence of ``accept`` discover unseen instances of the kind's loose shape;
their occurrences become spans where they overlap no base span. Base spans stay.

Positions without a user function: matches are wrapped in a private-use character (one
that the text holds is first replaced by another of equal length), the text is split at
it, and lengths are added up. Quantifiers are possessive where that changes no match,
so that long runs cost linear time and no stack.

Defined results: null text is empty: no spans; empty tables give empty results; rows
that share a doc_id are searched each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as given, in a form that Java matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match holds.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: What an unseen instance of a kind looks like at least.
SHAPES = {
    "email": r"^[^@\s]*[A-Za-z0-9][^@\s]*\x20*(?:@|\(at\)|\[at\])\x20*[^@\s]*[A-Za-z0-9][^@\s]*$",
    "ip": r"^[0-9]{1,3}(?:(?:\x20*[.:_-]\x20*|\x20+)[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]\x20*+[._-]?\x20*+){12,18}[0-9]$",
    "phone": r"^[+]?[(]?[0-9](?:[()./_\x20-]*+[0-9]){6,14}$",
}
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S{4,}+"
#: Identifiers of several words: a run of digit groups; a name, an at sign and a domain.
SPACED = r"(?<!\S)[+(]*+[0-9][0-9().:/_+-]*+(?:\x20++[0-9().:/_+-]++(?=[,;!?\]\"']*+(?!\S)))++|(?<!\S)\S*[A-Za-z0-9]\x20*+(?:@|\(at\)|\[at\])\x20*+[A-Za-z0-9]\S*+"
#: The last word and the word before it (an opening bracket or quote at the end is no word); the next word.
L1, L2 = r"(?s)^.*(?<!\S)(?![(\[\"'<]++$)(\S++)\s*+[(\[\"'<]*+$", r"(?s)^.*(?<!\S)(\S++)\s++(?![(\[\"'<]++$)\S++\s*+[(\[\"'<]*+$"
R1 = r"^(?:[.,;:!?)\]\"']++(?!\S))?+\s*+(\S++)"
MARK, STAND_IN = "\ue000", "\ue001"
SPAN = "array<struct<start:long,end:long,value:string>>"
SEEN = SPAN.replace("value:string", "value:string,l1:string,l2:string,r1:string")
EXTRA = "array<struct<start:long,end:long,kind:string>>"
ROUNDS, ACCEPT, MIN_SEEDS = 3, 0.8, 3


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, context: bool = False) -> Column:
    """Array of (start, end, value[, l1, l2, r1]) of the matches of ``pattern``, in order: those
    that ``keep`` holds for, with the two words to the left and the word to the right."""
    clean = F.replace(text, F.lit(MARK), F.lit(STAND_IN))
    split = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK)
    word = lambda side, re: F.lower(F.regexp_extract(side, re, 1))

    def found(parts: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            end = s.pos + F.length(F.get(parts, i))
            one = F.struct(s.pos.alias("start"), end.alias("end"), F.get(parts, i).alias("value"), i.alias("i"))
            return F.struct(end.alias("pos"), F.when(i % 2 == 1, F.concat(s.out, F.array(one))).otherwise(s.out).alias("out"))

        start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(SPAN.replace("value:string", "value:string,i:int")).alias("out"))
        spans = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, step, lambda s: s.out)
        if keep is not None:
            spans = F.filter(spans, lambda s: keep(s.value))
        piece = lambda i: F.coalesce(F.get(parts, i), F.lit(""))

        def left(s: Column) -> Column:
            """The text before: as a rule two matches and the gaps around them hold two words."""
            near = F.concat(*[piece(s.i - k) for k in (5, 4, 3, 2, 1)])
            return F.when((s.i <= 5) | near.rlike(r"\s\S++\s++\S++\s*+[(\[\"'<]*+$"), near).otherwise(F.array_join(F.slice(parts, F.lit(1), s.i), ""))

        def right(s: Column) -> Column:
            near = F.concat(*[piece(s.i + k) for k in (1, 2, 3)])
            return F.when((s.i + 4 >= F.size(parts)) | near.rlike(R1 + r"\s"), near).otherwise(F.array_join(F.slice(parts, s.i + 2, F.size(parts)), ""))

        words = lambda s: [word(left(s), L1).alias("l1"), word(left(s), L2).alias("l2"), word(right(s), R1).alias("r1")] if context else []
        return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), *words(s)))

    # bound by a lambda, so that the text is matched and split once, not once a match
    none = F.array().cast(SEEN if context else SPAN)
    return F.get(F.transform(F.array(split), lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none)), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    digits = _digits(v)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, context: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    spans = located(text, PATTERNS[kind], lambda v: valid(kind, v), context)
    # most texts hold no such character: a byte search is cheaper than a match
    return F.when(text.contains(NEEDS[kind]), spans).otherwise(F.array().cast(SEEN if context else SPAN)) if kind in NEEDS else spans


def kinded(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(F.coalesce(spans, F.array().cast(EXTRA)), lambda e: e.kind == kind)


def written(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end))


def scanned(docs: DataFrame, carried: bool = False) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, tokens, spaced[, doc]): one pass over the texts, stored;
    ``doc`` holds all columns of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = text.rlike("[0-9@]")
    seen = lambda pattern, keep=None: F.when(some, located(text, pattern, keep, True)).otherwise(F.array().cast(SEEN))
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carried else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *[base_spans(text, k, True).alias(k) for k in KINDS], seen(TOKEN).alias("tokens"), seen(SPACED, lambda v: v.contains(" ") & v.rlike("[0-9@]")).alias("spaced"), *doc)
    return common.stored(rows, "scan")


def shaped(value: Column) -> Column:
    return reduce(Column.__or__, [value.rlike(re) for re in SHAPES.values()])


def _occurrences(scan: DataFrame) -> DataFrame:
    """(row, start, end, value, kind or null, pattern): a row for each occurrence and pattern."""

    def occurrence(s: Column, value: Column, kind: Column) -> Column:
        end = s.start + F.length(value)
        return F.struct(s.start.alias("start"), end.alias("end"), value.alias("value"), kind.cast("string").alias("kind"), s.l1.alias("l1"), s.l2.alias("l2"), s.r1.alias("r1"))

    def trimmed(name: str) -> Column:
        return F.transform(name, lambda t: occurrence(t, F.regexp_replace(t.value, r"[.,;:!?)\]\"']+$", ""), F.lit(None)))

    def based(name: str) -> Column:
        return F.transform(name, lambda s: occurrence(s, s.value, F.lit(name)))

    free = lambda t: ~F.exists("bases", lambda b: (b.start < t.end) & (b.end > t.start))
    within = lambda t: F.exists("runs", lambda r: (r.start <= t.start) & (r.end >= t.end))
    seen = scan.where(F.size("tokens") + F.size("spaced") + sum(F.size(k) for k in KINDS) > 0).select("row", F.concat(*[based(k) for k in KINDS]).alias("bases"), trimmed("tokens").alias("tokens"), trimmed("spaced").alias("spaced"))
    seen = seen.withColumn("runs", F.filter("spaced", lambda t: t.value.contains(" ") & shaped(t.value) & free(t)))
    # a token in a longer candidate is a fragment, unless it looks like an identifier by itself
    single = F.filter("tokens", lambda t: (F.length(t.value) > 0) & free(t) & (~within(t) | shaped(t.value)))
    each = seen.select("row", F.explode(F.concat("bases", "runs", single)).alias("o")).select("row", "o.*")
    patterns = F.array(F.concat(F.lit("L "), "l2", F.lit(" "), "l1"), F.concat(F.lit("M "), "l1", F.lit(" _ "), "r1"))
    # a pattern needs both its words: others say nothing
    return each.select("*", F.explode(F.filter(patterns, lambda p: ~p.rlike(r"^L  |^M  |_ $| $"))).alias("pattern")).drop("l1", "l2", "r1")


def bootstrap(scan: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(row, kind, start, end): unseen identifiers that accepted patterns discover."""
    seen = common.stored(_occurrences(scan), "occurrences")
    edges = seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    # only patterns with a seed can ever gain confidence in the first round; all stay in the graph
    edges = common.stored(edges, "graph")
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores, chosen = seeds, None
    for _ in range(rounds):
        gained = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum(F.when(F.col("score") >= 1, 1).otherwise(0)).alias("seeds"))
        chosen = common.stored(gained.where(F.col("seeds") >= min_seeds).join(size, "pattern").withColumn("confidence", F.col("sum") / (F.col("n") + 1)).where(F.col("confidence") >= accept).select("pattern", F.col("kind").alias("of"), "confidence"), "patterns")
        shape = F.coalesce(*[F.when(F.col("of") == k, F.col("value").rlike(re)) for k, re in SHAPES.items()])
        noisy = F.lit(1.0) - F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))))
        new = edges.where("kind is null").join(chosen, "pattern").where(shape).groupBy("value", F.col("of").alias("kind")).agg(F.least(noisy, F.lit(0.999)).alias("score"))
        scores = common.stored(seeds.unionByName(new), "scores")
    best = scores.where("score < 1").groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", F.col("b.kind").alias("new_kind"))
    found = seen.where("kind is null").join(chosen.select("pattern", "of"), "pattern").join(best, "value").where("of = new_kind")
    return found.select("row", F.col("new_kind").alias("kind"), "start", "end").distinct()


def find_pii(docs: DataFrame) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, extra): base spans, and what the method adds."""
    scan = scanned(docs)
    found = common.stored(bootstrap(scan), "found")
    extra = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("extra"))
    return scan.drop("tokens", "spaced").join(extra, "row", "left")


def spans_text(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    base = F.concat(*[written(kinded(F.col(k), k)) for k in KINDS])
    both = F.concat(*[written(F.array_sort(F.concat(kinded(F.col(k), k), of_kind(F.col("extra"), k)))) for k in KINDS])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(both, ",").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with (start, end, kind) spans, by start, replaced by [KIND]; of spans that
    overlap, one span from the first start to the last end, named by the first."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        inside = x.start < s.pos
        piece = F.array(F.substring(text, (s.pos + 1).cast("int"), (x.start - s.pos).cast("int")), F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))
        return F.struct(F.greatest(s.pos, x.end).alias("pos"), F.when(inside, s.out).otherwise(F.concat(s.out, piece)).alias("out"))

    tail = lambda s: F.array_join(F.concat(s.out, F.array(F.substring(text, (s.pos + 1).cast("int"), F.length(text)))), "")
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the identifiers in ``text`` replaced by their kind, ``n_chars`` renewed if there."""
    scan = scanned(docs, carried=True)
    extra = bootstrap(scan.drop("doc")).groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("extra"))
    extra = common.stored(extra, "extra")
    n, spans = extra.agg(F.count(F.lit(1)), F.sum(F.size("extra"))).first()
    rows = scan.select("row", "doc", *KINDS)
    if n:
        rows = rows.join(F.broadcast(extra) if 32 * n + 48 * spans <= common.BROADCAST_BYTES else extra, "row", "left")
    else:
        rows = rows.withColumn("extra", F.lit(None).cast(EXTRA))
    every = F.array_sort(F.concat(*[kinded(F.col(k), k) for k in KINDS], F.coalesce("extra", F.array().cast(EXTRA))))
    rows = rows.withColumn("spans", every).withColumn("clean", F.when(F.col("doc.text").isNotNull(), redacted(F.col("doc.text"), F.col("spans"))))
    renewed = {"text": F.col("clean")} | ({"n_chars": F.length("clean").cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*[renewed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
