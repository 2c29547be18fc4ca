"""The pipeline language: tokens, command trees, errors with places, canonical text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.regexps import MODIFIERS


class ConfigError(ValueError):
    """A pipeline text that can't be understood; the message ends with its place."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, regexp or one of ; { }
    text: str
    place: str

    @property
    def unquoted(self) -> str:
        return self.text[1:-1] if self.kind == "string" else self.text

    @property
    def fixed(self) -> str:
        """A string without fields: its escapes resolved."""
        if self.kind != "string":
            return self.text
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), self.unquoted, flags=re.S)

    @property
    def pattern(self) -> tuple[str, str]:
        body, _, modifiers = self.text[1:].rpartition("~")
        return body, modifiers


_LEXEMES = re.compile(r"(?P<space>\s+)|(?P<comment>#[^\n]*)|(?P<mark>[;{}])|(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<regexp>~[^~]*~[A-Za-z]*)|(?P<open>['\"~].*)|(?P<word>[^\s;{}'\"~#]+)", re.S)
_UNCLOSED = {"'": "string", '"': "string", "~": "regular expression"}


def tokens(text: str, source: str = "config") -> list[Token]:
    out, line = [], 1
    for m in _LEXEMES.finditer(text):
        kind, value, place = m.lastgroup, m[0], f"[{source}:{line}]"
        line += value.count("\n")
        if kind == "open":
            raise ConfigError(f"the {_UNCLOSED[value[0]]} has no end: {value} {place}")
        if kind == "regexp" and (wrong := value.rpartition("~")[2].strip(MODIFIERS)):
            raise ConfigError(f"regular expressions have no modifier {wrong[0]} {place}")
        if kind == "mark":
            out.append(Token(value, value, place))
        elif kind not in ("space", "comment"):
            out.append(Token(kind, value, place))
    return out


@dataclass
class Node:
    """A command: its name and arguments, and the commands in its braces."""

    name: Token
    args: list[Token] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def words(self) -> str:
        return " ".join(t.text for t in (self.name, *self.args))

    def error(self, message: str) -> ConfigError:
        return ConfigError(f"{message}: {self.words()} {self.name.place}")

    def canonical(self, depth: int = 0) -> str:
        pad = "    " * depth
        if not self.children:
            return f"{pad}{self.words()};\n"
        return f"{pad}{self.words()} {{\n" + "".join(c.canonical(depth + 1) for c in self.children) + f"{pad}}}\n"


def parse_tree(text: str, source: str = "config") -> list[Node]:
    """The commands of a pipeline text. The last ``;`` of a block may be missing."""
    stack: list[list[Node]] = [[]]
    current: Node | None = None
    for t in tokens(text, source):
        if t.kind == "{":
            if current is None:
                raise ConfigError(f"a brace opens without a command {t.place}")
            stack.append(current.children)
            current = None
        elif t.kind == "}":
            if len(stack) == 1:
                raise ConfigError(f"a brace closes that none has opened {t.place}")
            stack.pop()
            current = None
        elif t.kind == ";":
            if current is None:
                raise ConfigError(f"a semicolon ends no command {t.place}")
            current = None
        elif current is not None:
            current.args.append(t)
        elif t.kind == "word":
            current = Node(t)
            stack[-1].append(current)
        else:
            raise ConfigError(f"a command can't begin with {t.text} {t.place}")
    if len(stack) > 1:
        raise ConfigError(f"the text ends within a block [{source}]")
    return stack[0]


def canonical(nodes: list[Node]) -> str:
    return "".join(n.canonical() for n in nodes)
