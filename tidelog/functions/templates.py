"""Templates: text with ``$field`` and ``{$field}`` references, as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Template:
    """Alternating literals and field names: literal, field, literal, field, ..."""

    parts: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return self.parts[1::2]

    @property
    def constant(self) -> str | None:
        return self.parts[0] if len(self.parts) == 1 else None

    def column(self, df: DataFrame) -> Column:
        if (text := self.constant) is not None:
            return F.lit(text)
        if len(self.parts) == 2 and not self.parts[0]:  # a lone field keeps its bytes
            return F.coalesce(model.raw(df, self.parts[1]).cast("string"), F.lit(""))
        pieces = [model.read(df, p) if i % 2 else F.lit(p) for i, p in enumerate(self.parts) if i % 2 or p]
        return F.concat(*pieces)


def _starts(c: str) -> bool:
    return c.isascii() and (c.isalpha() or c == "_")


def parse_template(text: str, escapes: bool = True, references: bool = False) -> Template:
    """``escapes``: a backslash takes the next character (n, r, t: control characters).
    ``references``: what names no field (``$1``, ``${n}``) is left for a regular expression's
    replacement."""
    parts, buffer, i, n = [], [], 0, len(text)

    def bad(at: int) -> TemplateError:
        return TemplateError(f"a field's name can't begin with '{text[at]}', at {at} in: {text}")

    def name_from(at: int) -> tuple[str, int]:
        to = at
        while to < n and text[to].isascii() and (text[to].isalnum() or text[to] == "_"):
            to += 1
        return text[at:to], to

    while i < n:
        c = text[i]
        if c == "\\" and escapes and i + 1 < n:
            after = text[i + 1]
            buffer.append(_ESCAPES.get(after, after))
            i += 2
        elif c == "$" and i + 1 < n:
            if references and not _starts(text[i + 1]):
                buffer.append(c)
                i += 1
                continue
            if not _starts(text[i + 1]):
                raise bad(i + 1)
            name, i = name_from(i + 1)
            parts += ["".join(buffer), name]
            buffer = []
        elif c == "{" and i + 2 < n and text[i + 1] == "$" or c == "{" and text[i + 1 : i + 2] == "$":
            if i + 2 >= n or not _starts(text[i + 2]):
                if references and i + 2 < n:
                    buffer.append(c)
                    i += 1
                    continue
                if i + 2 >= n:
                    buffer.append(text[i:])
                    break
                raise bad(i + 2)
            name, to = name_from(i + 2)
            if text[to : to + 1] != "}":
                if to >= n:
                    buffer.append(text[i:])
                    break
                raise TemplateError(f"a field's name can't hold '{text[to]}', at {to} in: {text}")
            parts += ["".join(buffer), name]
            buffer, i = [], to + 1
        else:
            buffer.append(c)
            i += 1
    if buffer or not parts:
        parts.append("".join(buffer))
    return Template(tuple(parts))
