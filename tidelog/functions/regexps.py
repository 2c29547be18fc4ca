"""Regular expression literals ``~body~modifiers`` and what Spark needs to know of them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

MODIFIERS = "idxmsuU"
_GROUP = re.compile(r"\\Q.*?(?:\\E|$)|\\.|\[(?:\\.|\[(?:\\.|[^\]])*\]|[^\]\\])*\]|\((\?(?:<([a-zA-Z][a-zA-Z0-9]*)>)?)?", re.S)


@dataclass(frozen=True)
class Regexp:
    body: str
    modifiers: str = ""

    @property
    def java(self) -> str:
        """The expression with its modifiers as inline flags."""
        return f"(?{self.modifiers}){self.body}" if self.modifiers else self.body

    @cached_property
    def _groups(self) -> tuple[int, dict[str, int]]:
        count, names = 0, {}
        for m in _GROUP.finditer(self.body):
            if m[0] == "(":
                count += 1
            elif m[2]:
                count += 1
                names[m[2]] = count
        return count, names

    @property
    def group_count(self) -> int:
        return self._groups[0]

    @property
    def names(self) -> dict[str, int]:
        """Named groups and their numbers."""
        return self._groups[1]

    def check(self, spark) -> str | None:
        """The error of Java's compiler, if the expression is invalid."""
        from pyspark.errors import IllegalArgumentException

        try:
            spark._jvm.java.util.regex.Pattern.compile(self.java)
        except IllegalArgumentException as e:
            return str(e)
        return None
