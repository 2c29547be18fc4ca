"""The message model: a DataFrame row is a message, its string columns are its fields.

Fields that the pipeline knows are columns (so that Catalyst prunes and pushes down);
fields that only the data knows (from JSON objects or packs) are in the map column
``_rest``, which exists only where needed. Absent and empty are the same: a write stores
NULL for an empty value, a read gives '' for NULL. Columns that start with an underscore
are the engine's own: ``_seq`` (message number, the order of a stream) and ``_rest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST, SEQ = "_rest", "_seq"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame) -> list[str]:
    """Names of the known fields."""
    return [c for c in df.columns if not c.startswith("_")]


def raw(df: DataFrame, name: str) -> Column:
    """The field's value with its bytes as they are; NULL if absent."""
    if name in df.columns:
        kind = df.schema[name].dataType.simpleString()
        return quoted(name) if kind in ("string", "binary") else quoted(name).cast("string")
    if REST in df.columns:
        return F.col(REST)[name]
    return F.lit(None).cast("string")


def read(df: DataFrame, name: str) -> Column:
    """The field's value as text; '' if absent; invalid UTF-8 becomes U+FFFD."""
    return F.coalesce(F.make_valid_utf8(raw(df, name).cast("string")), F.lit(""))


def write(df: DataFrame, values: dict[str, Column], guard: Column | None = None) -> DataFrame:
    """Assign fields at once; '' and NULL unset them. ``guard``: only in rows where it holds."""
    new = {}
    for name, value in values.items():
        value = F.nullif(value.cast("string"), F.lit(""))
        new[name] = value if guard is None else F.when(guard, value).otherwise(raw(df, name).cast("string"))
    fresh = [n for n in values if n not in df.columns]
    out = df.withColumns(new)
    if REST in df.columns and fresh:
        out = out.withColumn(REST, F.map_filter(REST, lambda k, _: ~k.isin(fresh)))
    return out


def as_map(df: DataFrame, names: list[str] | None = None) -> Column:
    """map<string,string> of the fields that a message has."""
    names = fields(df) if names is None else names
    own = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[raw(df, n).cast("string") for n in names])) if names else F.create_map().cast("map<string,string>")
    own = F.map_filter(own, lambda _, v: v.isNotNull() & (v != ""))
    return F.map_concat(own, F.coalesce(F.col(REST), F.create_map().cast("map<string,string>"))) if REST in df.columns else own


def union(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    """Bag union of two streams of messages; fields that one side lacks are absent there."""
    if a is None or b is None:
        return b if a is None else a
    same = {c for c in a.columns if c in b.columns and a.schema[c].dataType != b.schema[c].dataType}
    a, b = (x.withColumns({c: quoted(c).cast("string") for c in same}) for x in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def messages(df: DataFrame) -> DataFrame:
    """A table as messages: every column of a simple type a field, as text."""
    keep = [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("void",) and not f.dataType.simpleString().startswith(("array", "map", "struct"))]
    return df.select(*[F.nullif(quoted(c).cast("string"), F.lit("")).alias(c) if not c.startswith("_") else quoted(c) for c in keep])
