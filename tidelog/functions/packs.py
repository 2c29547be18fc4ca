"""The pack format: a batch of messages in bytes, with one shared header of field names.

``NUM names, name..., NUM messages, value...``; names and values are ``NUM length`` and
bytes; NUM is a base-128 number, lowest group first, with the top bit set on all bytes
but the last. An absent field is a value of length 0.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model

MAX_NUM_BYTES = 10


class PackError(ValueError):
    pass


def write_num(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_num(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at``, and where it ends."""
    n = 0
    for i in range(MAX_NUM_BYTES):
        if at + i >= len(data):
            raise PackError("the pack ends within a number")
        n |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return n, at + i + 1
    raise PackError("a number is too long")


def _string(value: bytes) -> bytes:
    return write_num(len(value)) + value


def encode(messages: Iterable[dict[str, bytes]]) -> bytes:
    messages = list(messages)
    names = sorted({n for m in messages for n, v in m.items() if v})
    parts = [write_num(len(names)), *(_string(n.encode()) for n in names), write_num(len(messages))]
    parts += [_string(m.get(n) or b"") for m in messages for n in names]
    return b"".join(parts)


def decode(data: bytes) -> list[dict[str, bytes]]:
    at = 0

    def string() -> bytes:
        nonlocal at
        n, at = read_num(data, at)
        if at + n > len(data):
            raise PackError("the pack ends within a value")
        at += n
        return data[at - n : at]

    n, at = read_num(data, at)
    names = [string().decode() for _ in range(n)]
    count, at = read_num(data, at)
    return [{k: v for k, v in [(k, string()) for k in names] if v} for _ in range(count)]


@F.pandas_udf(T.BinaryType())
def _encode_one(fields: pd.Series) -> pd.Series:
    return fields.map(lambda m: encode([{k: bytes(v) for k, v in (m.items() if isinstance(m, dict) else m)}]))


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.BinaryType())))
def _decode_all(payload: pd.Series) -> pd.Series:
    def one(data):
        try:
            return decode(bytes(data)) if data is not None else None
        except (PackError, UnicodeDecodeError):
            return None

    return payload.map(one)


def pack(df: DataFrame, names: list[str] | None = None) -> Column:
    """A pack of each message by itself, as BINARY (Arrow batches, not row by row)."""
    return _encode_one(F.transform_values(model.as_map(df, names), lambda _, v: v.cast("binary")))


def unpacked(payload: Column) -> Column:
    """array<map<string,string>> of a pack's messages; NULL if it can't be read."""
    return F.transform(_decode_all(payload.cast("binary")), lambda m: F.transform_values(m, lambda _, v: v.cast("string")))
