"""Field functions: what ``set $field <function> ...`` computes, as Spark columns.

Every function takes the DataFrame of messages first and gives a column; nothing here
leaves the JVM but the pack format's codec (see ``packs``).
"""

from __future__ import annotations

import os
import re
import socket

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from .regexps import Regexp

#: syslog's severity names by number.
SEVERITIES = ("EMERG", "ALERT", "CRIT", "ERR", "WARNING", "NOTICE", "INFO", "DEBUG")
#: What stands for a date or a file name that is none.
INVALID_DATE, NO_NAME = "invalid-date", "noname"
DEFAULT_FACILITY, DEFAULT_SEVERITY = 1, 6

# --- whole-message functions -------------------------------------------------------


def dump(df: DataFrame) -> Column:
    """``#<number>``, then a line ``$name=value`` for each field, by name."""
    number = F.concat(F.lit("#"), F.coalesce(F.col(model.SEQ).cast("string"), F.lit("0"))) if model.SEQ in df.columns else F.lit("#0")
    if model.REST in df.columns:
        lines = F.transform(F.array_sort(F.map_entries(model.as_map(df))), lambda e: F.concat(F.lit("$"), e["key"], F.lit("="), F.make_valid_utf8(e["value"])))
        return F.array_join(F.concat(F.array(number), lines), "\n")
    return F.concat_ws("\n", number, *[F.when(model.read(df, n) != "", F.concat(F.lit(f"${n}="), model.read(df, n))) for n in sorted(model.fields(df))])


def to_json(df: DataFrame, names: list[str] | None = None) -> Column:
    """A JSON object of strings: named fields in their order ('' if absent), or all by name."""
    if names:
        body = F.to_json(F.struct(*[model.read(df, n).alias(n) for n in names]))
    elif model.REST in df.columns:
        valid = F.transform_values(model.as_map(df), lambda _, v: F.make_valid_utf8(v))
        body = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(valid))))
    elif known := sorted(model.fields(df)):
        body = F.to_json(F.struct(*[F.nullif(model.read(df, n), F.lit("")).alias(n) for n in known]))
    else:
        body = F.lit("{}")
    # line separators of Unicode end lines in JavaScript and are escaped, too
    return F.replace(F.replace(body, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


# --- replace -------------------------------------------------------------------------


def _replacement_guard(regexp: Regexp) -> str:
    """A pattern of the replacements that Java accepts for ``regexp``."""
    names = "|".join(map(re.escape, regexp.names)) or "(?!)"
    return rf"(?s)^(?:[^$\\]|\\.|\$[0-{min(9, regexp.group_count)}]|\$\{{(?:{names})\}})*\z"


def replace(regexp: Regexp, replacement: Column, subject: Column) -> Column:
    """All matches replaced; a replacement that Java would reject leaves the subject as it is."""
    done = F.regexp_replace(subject, F.lit(regexp.java), replacement)
    return F.when(replacement.rlike(_replacement_guard(regexp)), done).otherwise(subject)


# --- date and time ---------------------------------------------------------------------

#: The two shapes of a date, both with a time zone, that make an instant.
_ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$"
_NGINX = r"^\d\d/[A-Za-z]{3}/\d{4}:\d\d:\d\d:\d\d ([+-]\d{4})$"
NAMED = ("time", "date", "datetime", "unixtime-seconds", "unixtime-milliseconds", "unixtime-microseconds", "unixtime-nanoseconds")
#: Pattern letters that Spark formats as java.time does; letters of a zone, whose texts come from
#: the offset; letters of plain numbers. Letters of a locale's weeks or day periods have no place.
_LETTERS, _OFFSETS, _NUMBERS = set("GyMLdDQqEaHhKkmsSF"), set("XxZOVz"), set("unNAg")
LETTERS = _LETTERS | _OFFSETS | _NUMBERS


class PatternError(ValueError):
    pass


def instant(subject: Column) -> tuple[Column, Column]:
    """(local time, offset '+hh:mm') of a date text; both NULL if it is none."""
    iso = F.regexp_extract(subject, _ISO, 1)
    nginx = F.regexp_extract(subject, _NGINX, 1)
    local = F.when(iso != "", F.try_to_timestamp(F.left(subject, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).when(nginx != "", F.try_to_timestamp(F.left(subject, F.lit(20)), F.lit("dd/MMM/yyyy:HH:mm:ss")))
    offset = F.when(iso == "Z", F.lit("+00:00")).when(iso != "", iso).when(nginx != "", F.concat(F.left(nginx, F.lit(3)), F.lit(":"), F.right(nginx, F.lit(2))))
    return local, F.when(local.isNotNull(), offset)


def _div(a: Column, b: int) -> Column:
    """Whole-number quotient towards zero."""
    return ((a - a % b) / b).cast("long")


def _offset_seconds(offset: Column) -> Column:
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    return F.when(F.left(offset, F.lit(1)) == "-", -minutes).otherwise(minutes) * 60


def _offset_as(letters: str, offset: Column) -> Column:
    kind, n = letters[0], len(letters)
    plain, packed = offset, F.replace(offset, F.lit(":"), F.lit(""))
    hours = F.when(F.right(offset, F.lit(2)) == "00", F.left(offset, F.lit(3))).otherwise(packed)
    if kind == "Z" and n <= 3 or kind in "Xx" and n in (2, 4):
        out = packed
    elif kind in "Xx" and n == 1:
        out = hours
    elif kind in "Xx" and n in (3, 5) or kind == "Z" and n == 5:
        out = plain
    elif kind == "O" and n == 4 or kind == "Z" and n == 4:
        return F.when(offset == "+00:00", F.lit("GMT")).otherwise(F.concat(F.lit("GMT"), plain))
    else:  # V, z: an offset is its own name
        return F.when(offset == "+00:00", F.lit("Z")).otherwise(plain)
    zero = kind == "X" or kind == "Z" and n == 5
    return F.when(offset == "+00:00", F.lit("Z")).otherwise(out) if zero else out


def zone_letters(letters: str) -> bool:
    """Whether java.time knows a run of so many letters of a zone, and an offset can fill it."""
    return len(letters) in {"X": (1, 2, 3, 4, 5), "x": (1, 2, 3, 4, 5), "Z": (1, 2, 3, 4, 5), "O": (4,), "V": (2,), "z": (1, 2, 3, 4)}[letters[0]]


def _number_as(letters: str, local: Column) -> Column:
    """A plain number of the clock or calendar, filled with zeros to as many digits as letters."""
    micros = F.unix_micros(local)
    day = F.pmod(micros, F.lit(86_400_000_000))
    if letters == "uu":
        value = F.year(local) % 100
    else:
        value = {"u": F.year(local), "n": F.pmod(micros, F.lit(1_000_000)) * 1000, "N": day * 1000, "A": _div(day, 1000), "g": F.unix_date(local.cast("date")) + 40_587}[letters[0]]
    digits = F.abs(value).cast("string")
    filled = F.when(F.length(digits) < len(letters), F.lpad(digits, len(letters), "0")).otherwise(digits)
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), filled)


def check_pattern(pattern: str, now: bool = False) -> None:
    """Raise PatternError for a pattern that ``time`` can't format. ``now``: it has no subject."""
    for kind, text in _pieces(pattern):
        if now and kind == "zone" and text[0] == "z":
            raise PatternError("a date pattern can hold the letter z for a date after `in` only")


def _pieces(pattern: str) -> list[tuple[str, str]]:
    """The parts of a pattern: letters of a zone, letters of a plain number, what Spark formats."""
    pieces: list[tuple[str, str]] = []
    for m in re.finditer(r"'(?:[^']|'')*'|([A-Za-z])\1*|[^A-Za-z']+", pattern):
        letter = m[1] or ""
        if letter and letter not in LETTERS:
            raise PatternError(f"a date pattern can't hold the letter {letter}")
        kind = "zone" if letter in _OFFSETS else "number" if letter in _NUMBERS else "plain"
        if letter and kind == "zone" and not zone_letters(m[0]):
            raise PatternError(f"no such letters of a zone in a date pattern: {m[0]}")
        if kind == "plain" and pieces and pieces[-1][0] == "plain":
            pieces[-1] = (kind, pieces[-1][1] + m[0])
        else:
            pieces.append((kind if letter else "plain", m[0]))
    return pieces


def _pattern(pattern: str, local: Column, offset: Column, zone: str | None) -> Column:
    """``pattern`` of java.time, its letters of a zone filled in from ``offset`` and the ``zone``'s name."""
    out = []
    for kind, text in _pieces(pattern):
        if kind == "zone":
            out.append(F.lit(zone) if zone and text[0] == "V" else _offset_as(text, offset))
        else:
            out.append(_number_as(text, local) if kind == "number" else F.date_format(local, text))
    return F.concat(*out) if out else F.lit("")


def format_time(fmt: str, local: Column, offset: Column, zone: str | None = None) -> Column:
    """``fmt``: one of NAMED, or a pattern. ``local`` is shown as the clock stands there."""
    if fmt.startswith("unixtime-"):
        micros = F.unix_micros(local) - _offset_seconds(offset).cast("long") * 1_000_000
        div = {"unixtime-seconds": 1_000_000, "unixtime-milliseconds": 1_000}.get(fmt)
        if div:
            return _div(micros, div).cast("string")
        if fmt == "unixtime-microseconds":
            return micros.cast("string")
        if fmt == "unixtime-nanoseconds":
            return (micros * 1000).cast("string")
        raise PatternError(f"there is no date format {fmt}")
    named = {"time": "HH:mm:ss", "date": "yyyy-MM-dd"}
    if fmt == "datetime":
        return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return _pattern(named.get(fmt, fmt), local, offset, zone)


def time(fmt: str, subject: Column | None = None, now: Column | None = None, zone: str = "UTC") -> Column:
    """A date text reformatted, its offset kept ('invalid-date' if it is none); without a
    subject the current time in ``zone``. The session's zone must be UTC."""
    if subject is not None:
        local, offset = instant(subject)
        return F.coalesce(format_time(fmt, local, offset), F.lit(INVALID_DATE))
    if fmt not in NAMED:
        check_pattern(fmt, now=True)
    return format_time(fmt, *clock(now, zone), zone)


def clock(now: Column | None = None, zone: str = "UTC") -> tuple[Column, Column]:
    """Local time in ``zone`` and its offset, now or at ``now``."""
    now = F.current_timestamp() if now is None else now
    local = F.from_utc_timestamp(now, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(now)) / 60).cast("int")
    size = F.abs(minutes)
    hours, rest = (F.lpad(x.cast("string"), 2, "0") for x in (_div(size, 60), size % 60))
    return local, F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), hours, F.lit(":"), rest)


# --- syslog ------------------------------------------------------------------------------


def _number(text: Column, default: int) -> Column:
    """Text as Java reads an int: no blanks; anything else is the default."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")), F.lit(default))


def syslog(df: DataFrame, now: Column | None = None, host_name: str | None = None, zone: str = "UTC") -> Column:
    """An IETF syslog line of the message's syslog fields."""
    priority = _number(model.read(df, "facility"), DEFAULT_FACILITY) * 8 + _number(model.read(df, "severity"), DEFAULT_SEVERITY)
    local, offset = instant(model.read(df, "date"))
    date = F.coalesce(format_time("datetime", local, offset), format_time("datetime", *clock(now, zone)))
    or_else = lambda name, default: F.coalesce(F.nullif(model.read(df, name), F.lit("")), F.lit(default))
    return F.concat(F.lit("<"), priority, F.lit(">1 "), date, F.lit(" "), or_else("host", host_name or host()), F.lit(" "), or_else("program", "-"), F.lit(" "), or_else("pid", "-"), F.lit(" - - "), model.read(df, "payload"))


def syslog_frame(df: DataFrame) -> Column:
    """The payload prefixed with its length in bytes."""
    payload = F.coalesce(model.raw(df, "payload").cast("string"), F.lit(""))
    return F.concat(F.octet_length(payload).cast("string"), F.lit(" "), payload)


# --- small ones ----------------------------------------------------------------------------


def host() -> str:
    try:
        return socket.gethostname() or "unknown-hostname"
    except OSError:
        return "unknown-hostname"


def env(name: str) -> Column:
    """A variable of the driver's environment, as it was when the pipeline was compiled."""
    return F.lit(os.environ.get(name, ""))


def basename(path: Column) -> Column:
    """The last component of a path, safe as a file name."""
    last = F.regexp_replace(F.regexp_replace(path, r"(?s)/+\z", ""), r"(?s)^.*[/\\:;]", "")
    safe = F.regexp_replace(last, r"(?s)^(?:\.\.|\.|~|\|)\z|^~", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(NO_NAME))


def severity_name(number: Column, lowercase: bool = False) -> Column:
    """The name of a severity number; anything else as it is."""
    out = number
    for i, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(number == str(i), F.lit(name.lower() if lowercase else name)).otherwise(out)
    return out
