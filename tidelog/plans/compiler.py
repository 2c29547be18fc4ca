"""Lowering of a program to DataFrames.

Nothing is interpreted per message: each command is a DataFrame transformation, so
Catalyst sees one plan for a pipeline. Sinks are collected beside the main stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import fields, packs
from ..operators import parse, route
from . import commands as c

#: Commands that a guarded projection can express: one message in, at most one out.
_NARROW_PARSERS = ("syslog", "json", "regexp", "stats")


def narrow(body: tuple) -> bool:
    for x in body:
        if isinstance(x, c.Parse) and x.kind not in _NARROW_PARSERS:
            return False
        if isinstance(x, (c.From, c.Block)):
            return False
        if isinstance(x, c.Switch) and not all(narrow(inner) for _, inner in x.cases):
            return False
    return True


@dataclass
class Lowering:
    """``sources`` gives the stream of a ``from`` command. ``snapshots`` gives the metrics of a
    ``parse`` consumer. ``now``, ``host`` and ``nanos`` fix what else would change by itself."""

    sources: Callable[[c.From], DataFrame]
    options: c.Options = c.Options()
    dialect: c.Dialect = c.Dialect()
    snapshots: Callable[[str], dict[str, int]] = lambda consumer: {}
    now: Column | None = None
    host: str | None = None
    nanos: int | None = None
    json_keys: list[str] | None = None
    #: Called with the messages before and after a parser that drops what it can't parse.
    on_drop: Callable[[DataFrame, DataFrame], None] | None = None
    sinks: list[tuple[c.To, DataFrame]] = field(default_factory=list)

    def run(self, body: tuple, df: DataFrame | None = None, guard: Column | None = None) -> DataFrame | None:
        for x in body:
            df = self._one(x, df, guard)
        return df

    def _one(self, x, df: DataFrame | None, guard: Column | None) -> DataFrame | None:
        if isinstance(x, c.From):
            return model.union(df, self.sources(x))
        if isinstance(x, c.Block):
            inner = self.run(x.body, df if x.kind == "tee" else None)
            return model.union(df, inner) if x.kind == "join" else df
        if df is None:
            return None
        if isinstance(x, c.Set):
            return model.write(df, {x.field: self.value(x, df)}, guard)
        if isinstance(x, c.Keep):
            return route.keep(df, x.names, guard)
        if isinstance(x, c.Drop):
            return route.drop(df, guard)
        if isinstance(x, c.To):
            self.sinks.append((x, df if guard is None else df.where(guard)))
            return df
        if isinstance(x, c.Parse):
            out = self._parse(x, df, guard)
            if self.on_drop is not None and not x.keep_unparsed and x.kind in ("syslog", "json", "regexp"):
                self.on_drop(df, out)
            return out
        if isinstance(x, c.Switch):
            cases = [route.Case(m, (lambda d, g, b=b: self.run(b, d, g)) if narrow(b) else None, lambda d, b=b: self.run(b, d)) for m, b in x.cases]
            return route.switch(df, x.subject, cases, guard)
        raise TypeError(x)

    def _parse(self, x: c.Parse, df: DataFrame, guard: Column | None) -> DataFrame:
        if x.kind == "syslog":
            return parse.syslog(df, x.keep_unparsed, guard)
        if x.kind == "json":
            return parse.json_fields(df, x.keep_unparsed, guard, self.json_keys)
        if x.kind == "regexp":
            return parse.regexp(df, x.regexp, x.keep_unparsed, guard)
        if x.kind == "fieldpack":
            return parse.pack(df, x.keep_unparsed)
        if x.kind == "stats":
            return parse.stats(df, self.snapshots(x.consumer), guard, self.dialect.measurement, self.nanos)
        return parse.each_field(df)

    def value(self, x: c.Set, df: DataFrame) -> Column:
        if x.function == "template":
            return x.template.column(df)
        if x.function == "dump":
            return fields.dump(df)
        if x.function == "json":
            return fields.to_json(df, list(x.names))
        if x.function == "fieldpack":
            return packs.pack(df, list(x.names) or None)
        if x.function == "replace":
            subject = model.read(df, x.field) if x.subject is None else x.subject.column(df)
            return fields.replace(x.regexp, x.template.column(df), subject)
        if x.function == "time":
            return fields.time(x.text, None if x.subject is None else x.subject.column(df), self.now, self.options.zone)
        if x.function == "syslog":
            return fields.syslog(df, self.now, self.host, self.options.zone)
        if x.function == "syslog-frame":
            return fields.syslog_frame(df)
        if x.function == "host":
            return F.lit(self.host or fields.host())
        if x.function == "env":
            return fields.env(x.text)
        if x.function == "basename":
            return fields.basename(x.template.column(df))
        return fields.severity_name(x.template.column(df), x.lowercase)


def transform(text: str, df: DataFrame, dialect: c.Dialect | None = None, **kw) -> DataFrame | None:
    """A pipeline text applied to messages: what leaves its end, or None if nothing can."""
    dialect = dialect or c.Dialect()
    program = c.read_program(text, dialect=dialect, spark=df.sparkSession)
    return Lowering(kw.pop("sources", lambda s: None), program.options, dialect, **kw).run(program.body, df)
