"""Routing: union, isolation, fork, and conditional branches as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.regexps import Regexp
from ..functions.templates import Template
from . import parse


def set_fields(df: DataFrame, values: dict[str, Column], guard: Column | None = None) -> DataFrame:
    return model.write(df, values, guard)


def unset(df: DataFrame, names: Sequence[str], guard: Column | None = None) -> DataFrame:
    return model.write(df, {n: F.lit(None).cast("string") for n in names}, guard)


def keep(df: DataFrame, names: Sequence[str], guard: Column | None = None) -> DataFrame:
    """Drop all other fields; names that no field has don't matter."""
    if guard is not None:
        df = unset(df, [n for n in model.fields(df) if n not in names], guard)
        return df.withColumn(model.REST, F.when(guard, F.map_filter(model.REST, lambda k, _: k.isin(*names))).otherwise(F.col(model.REST))) if model.REST in df.columns else df
    if model.REST in df.columns:
        df = parse.promoted(df, [n for n in names if n not in df.columns])
    own = [c for c in df.columns if c.startswith("_") and c != model.REST]
    return df.select(*own, *[model.quoted(n) for n in dict.fromkeys(names) if n in df.columns])


def drop(df: DataFrame, guard: Column | None = None) -> DataFrame:
    return df.where(F.lit(False) if guard is None else ~guard)


@dataclass(frozen=True)
class Case:
    """A branch of ``switch``: matches by regular expression, by equal text, or always."""

    match: Regexp | Template | None
    #: One-to-one: (df, guard) -> df, run on all rows with guarded writes.
    narrow: Callable[[DataFrame, Column], DataFrame] | None = None
    #: Anything else: df -> df or None, run on the branch's rows alone.
    wide: Callable[[DataFrame], DataFrame | None] | None = None


def switch(df: DataFrame, subject: Template, cases: Sequence[Case], guard: Column | None = None) -> DataFrame:
    """The first case that matches takes the message; without a match it passes unchanged.
    All conditions are evaluated once, on the message as it comes, into a branch number.
    If every branch is narrow, the branches are guarded writes in one projection; otherwise
    each branch's rows are split off and united again."""
    depth = sum(c.startswith("_branch") for c in df.columns)
    name, text = f"_branch{depth}", f"_subject{depth}"
    both = lambda here: here if guard is None else here & guard
    df = df.withColumn(text, subject.column(df))
    choice = None
    for i, case in enumerate(cases):
        m = case.match
        hit = F.lit(True) if m is None else F.col(text).rlike(m.java) if isinstance(m, Regexp) else F.col(text) == m.column(df)
        choice = F.when(hit, i) if choice is None else choice.when(hit, i)
    df = df.withColumn(name, F.lit(-1) if choice is None else choice.otherwise(-1))
    for i, case in enumerate(cases):
        if isinstance(case.match, Regexp) and case.match.names:
            df = model.write(df, parse.captures(df, case.match, F.col(text)), both(F.col(name) == i))
    df = df.drop(text)
    if all(case.narrow is not None for case in cases):
        for i, case in enumerate(cases):
            df = case.narrow(df, both(F.col(name) == i))
        return df.drop(name)
    if guard is not None:
        raise ValueError("a branch that splits its rows can't be guarded")
    out = df.where(F.col(name) == -1).drop(name)
    for i, case in enumerate(cases):
        own = df.where(F.col(name) == i).drop(name)
        out = model.union(out, case.wide(own) if case.wide is not None else case.narrow(own, F.lit(True)))
    return out


def join(df: DataFrame | None, *streams: DataFrame | None) -> DataFrame | None:
    """Merge streams: a bag union, not a relational join."""
    for s in streams:
        df = model.union(df, s)
    return df
