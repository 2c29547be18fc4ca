"""Parsers: ``parse [keep-unparsed] <format>``.

One-to-one parsers are guarded column writes (one narrow projection); one-to-many ones
are a Generate. What can't be parsed is dropped, or kept unchanged on request. ``guard``
limits a one-to-one parser to the rows of a branch (see ``route.switch``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import packs
from ..functions.regexps import Regexp

#: The two syslog headers.
BSD = r"^<([0-9]+)>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d?\d\s+\d\d:\d\d:\d\d(?:\s+([^\s:]+))?\s+([^\s:]+):\s"
IETF = r"^<([0-9]+)>1\s(\d\d\d\d-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.\d*)?(Z|[+-]\d\d:\d\d)\s([^\s]+)\s([^\s]+)\s([^\s]+)\s([^\s]+)\s[^\s]+\s"
SYSLOG_FIELDS = ("date", "facility", "severity", "host", "program", "pid", "messageId", "payload")
#: Either header in one match; its ten groups, none of which can hold a line feed, and the rest.
_HEADER, _GROUPS = f"{IETF}|{BSD}", "".join(f"${i}\n" for i in range(1, 11))


def _finish(df: DataFrame, parsed: dict[str, Column], ok: Column, keep_unparsed: bool, guard: Column | None) -> DataFrame:
    """Write the ``parsed`` fields where ``ok``; drop other rows unless they are kept. The fields
    are made once, below a Generate: a filter above it can't be pushed into their expressions
    (each time with all of them in place of columns), and one on other columns still reaches
    the scan. A Generate is as good in a stream."""
    both = _both(ok, guard)
    written = model.write(df, parsed, both)
    names = list(parsed)
    passes = F.lit(True) if keep_unparsed else ok if guard is None else ok | ~guard
    made = F.struct(passes.alias("_passes"), *[model.quoted(n).alias(n) for n in names])
    out = written.select(*[model.quoted(c) for c in written.columns if c not in names], F.explode_outer(F.array(made)).alias("_made"))
    out = out if keep_unparsed else out.where("_made._passes")
    return out.select(*[F.col("_made")[c].alias(c) if c in names else model.quoted(c) for c in written.columns])


def _both(ok: Column, guard: Column | None) -> Column:
    return ok if guard is None else ok & guard


def syslog(df: DataFrame, keep_unparsed: bool = False, guard: Column | None = None) -> DataFrame:
    """BSD and IETF syslog lines; '-' and missing parts leave their field as it is."""
    line = model.read(df, "payload")
    # a header ends in another first character than '<' once its groups are written out
    parts = F.when(F.startswith(line, F.lit("<")), F.split(F.regexp_replace(line, _HEADER, _GROUPS), "\n", 11))
    df = df.withColumn("_parts", parts)
    part = lambda i: F.coalesce(F.get("_parts", F.lit(i - 1)), F.lit(""))
    ok = F.coalesce((F.size("_parts") == 11) & ~F.startswith(part(1), F.lit("<")), F.lit(False))
    bsd = part(1) == ""
    priority = F.when(bsd, part(8)).otherwise(part(1)).try_cast("int")
    old = lambda name: model.raw(df, name).cast("string")
    named = lambda name, value: F.when(value.isin("", "-"), old(name)).otherwise(value)
    either = lambda name, b, i: F.when(bsd, F.coalesce(F.nullif(part(b), F.lit("")), old(name)) if b else old(name)).otherwise(named(name, part(i)))
    values = {
        "facility": F.coalesce(((priority - F.pmod(priority, F.lit(8))) / 8).cast("int").cast("string"), old("facility")),
        "severity": F.coalesce((priority % 8).cast("string"), old("severity")),
        "date": F.when(bsd, old("date")).otherwise(F.concat(part(2), F.when(part(3) == "Z", F.lit("+00:00")).otherwise(part(3)))),
        "host": either("host", 9, 4),
        "program": either("program", 10, 5),
        "pid": either("pid", 0, 6),
        "messageId": either("messageId", 0, 7),
        "payload": part(11),
    }
    return _finish(df, values, ok, keep_unparsed, guard).drop("_parts")


def regexp(df: DataFrame, pattern: Regexp, keep_unparsed: bool = False, guard: Column | None = None) -> DataFrame:
    """The first match in the payload sets a field for each named group that takes part."""
    payload = model.read(df, "payload")
    df = df.withColumn("_line", payload)
    return _finish(df, captures(df, pattern, F.col("_line")), F.col("_line").rlike(pattern.java), keep_unparsed, guard).drop("_line")


def captures(df: DataFrame, pattern: Regexp, subject: Column) -> dict[str, Column]:
    """Values of the named groups. A group that matched nothing is told from one that took no part
    by a back-reference to it right after the match, which only holds in the former case: that
    the match (atomic, so that it is the same one) and the match with the reference start at
    the same place."""
    out = {}
    for name, i in pattern.names.items():
        value = F.regexp_extract(subject, pattern.java, i)
        took_part = F.regexp_instr(subject, F.lit(f"(?>{pattern.java})\\k<{name}>")) == F.regexp_instr(subject, F.lit(pattern.java))
        out[name] = F.when((value != "") | took_part, value).otherwise(model.raw(df, name).cast("string"))
    return out


_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_GAP = r"[ \t\r\n]*+"
_MEMBER = rf"{_STRING}{_GAP}:{_GAP}(?:{_STRING}|{_NUMBER}|true|false|null){_GAP}"
#: A flat object and nothing else (groups are possessive: linear time, no stack).
_FLAT = rf"^{_GAP}\{{{_GAP}(?:{_MEMBER}(?:,{_GAP}{_MEMBER})*+)?+\}}{_GAP}\z"
#: A member's number, from the end of the one before: between them are whole strings and other characters.
_NUMBERS = rf'\G((?:[^"]++|{_STRING}(?!{_GAP}:{_GAP}[-0-9]))*+{_STRING}{_GAP}:{_GAP})({_NUMBER})'


def json_object(payload: Column) -> Column:
    """map<string,string> of a flat JSON object, NULL if it is none: an array, a nested value, text
    after the object. Numbers keep their text: they are made strings before they are read."""
    quoted = F.regexp_replace(payload, _NUMBERS, '$1"$2"')
    return F.when(payload.rlike(_FLAT), F.from_json(quoted, "map<string,string>"))


def json_fields(df: DataFrame, keep_unparsed: bool = False, guard: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """A flat JSON object's members become fields; null and '' remove theirs. ``keys``: what the
    rest of the pipeline reads; other members are then left out, and no map column is made."""
    df = df.withColumn("_object", json_object(model.read(df, "payload")))
    got, ok = F.col("_object"), F.col("_object").isNotNull()
    known = model.fields(df)
    names = known if keys is None else list(dict.fromkeys([*(k for k in known if k in keys), *keys]))
    values = {n: F.when(F.map_contains_key(got, n), got[n]).otherwise(model.raw(df, n).cast("string")) for n in names}
    if keys is None:
        rest = F.map_filter(got, lambda k, v: ~k.isin(known) if known else F.lit(True))
        none = F.create_map().cast("map<string,string>")
        old = F.coalesce(F.col(model.REST), none) if model.REST in df.columns else none
        joined = F.map_filter(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(rest, k)), rest), lambda _, v: v.isNotNull() & (v != ""))
        df = df.withColumn(model.REST, F.when(_both(ok, guard), joined).otherwise(old))
    return _finish(df, values, ok, keep_unparsed, guard).drop("_object")


def promoted(df: DataFrame, names: list[str]) -> DataFrame:
    """Fields of the map column as columns of their own."""
    missing = [n for n in names if n not in df.columns]
    return model.write(df, {n: model.raw(df, n) for n in missing}) if missing else df


def pack(df: DataFrame, keep_unparsed: bool = False, keys: list[str] | None = None) -> DataFrame:
    """One message for each message of the pack in the payload; the original's fields go.
    ``keys``: field names to make columns of; without it fields are in the map column."""
    own = [c for c in df.columns if c == model.SEQ]
    cells = df.withColumn("_many", packs.unpacked(model.raw(df, "payload")))
    many = cells.where("_many is not null").select(*own, F.explode("_many").alias(model.REST))
    many = promoted(many, keys) if keys else many
    many = many.drop(model.REST) if keys else many
    if keep_unparsed:
        return model.union(many, cells.where("_many is null").drop("_many"))
    return many


def each_field(df: DataFrame) -> DataFrame:
    """A message (key, value) for each field; the original goes."""
    own = [c for c in df.columns if c == model.SEQ]
    return df.select(*own, model.as_map(df).alias("_all")).select(*own, F.explode("_all").alias("key", "value"))


def stats(df: DataFrame, snapshot: dict[str, int], guard: Column | None = None, measurement: str = "tidelog", now_nanos: int | None = None) -> DataFrame:
    """All metrics of a snapshot as fields, with the two rendered payloads (see ``streaming.metrics``)."""
    from ..streaming import metrics

    tags = F.array_sort(F.filter(F.map_entries(model.as_map(df)), lambda e: ~e["value"].contains(" ")))
    tag_text = F.array_join(F.transform(tags, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    head = F.when(tag_text == "", F.lit(measurement)).otherwise(F.concat(F.lit(f"{measurement},"), tag_text))
    nanos = F.lit(str(now_nanos)) if now_nanos is not None else (F.unix_micros(F.current_timestamp()) * 1000).cast("string")
    influx = F.concat(head, F.lit(" " + metrics.influx_values(snapshot) + " "), nanos)
    return model.write(df, {k: F.lit(str(v)) for k, v in snapshot.items()} | {"payload": F.lit(metrics.summary(snapshot)), "influxLineProtocolPayload": influx}, guard)
