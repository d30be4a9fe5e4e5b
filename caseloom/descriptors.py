"""Descriptors: entity names, and tuples of descriptors written ``x, (y, z)``.

A draft, ``<x>``, stands for a value before it is checked and stored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import MalformedDescriptorError

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|([(),<>]))", re.ASCII)
_CLOSES = {"(": ")", "<": ">"}


@dataclass(frozen=True)
class Node:
    def entities(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Name(Node):
    name: str

    def __str__(self) -> str:
        return self.name

    def entities(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class Group(Node):
    parts: tuple[Node, ...] = ()

    def __str__(self) -> str:
        inner = ", ".join(f"({p})" if isinstance(p, Group) and p.parts else str(p) for p in self.parts)
        return "()" if not self.parts else inner + "," * (len(self.parts) == 1)

    def entities(self) -> list[str]:
        return [e for p in self.parts for e in p.entities()]


@dataclass(frozen=True)
class Draft(Node):
    part: Node

    def __str__(self) -> str:
        return f"<{self.part}>"

    def entities(self) -> list[str]:
        return self.part.entities()


def parse(text: str) -> Node:
    """The node of a descriptor; errors name the place and what is wrong there."""

    def fail(why: str):
        raise MalformedDescriptorError(f"Can't parse descriptor {text!r}: {why}")

    # Each level: its opening mark and place, its parts, whether a comma was seen and is last.
    stack: list[list] = [["", 0, [], False, False]]
    at = 0
    if not text.strip():
        fail("it is empty")
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            k = at + len(text[at:]) - len(text[at:].lstrip())
            fail(f"illegal character {text[k]!r} (at position {k})")
        at, token = m.end(), m[1] or m[2]
        where = f"{'name ' if m[1] else ''}{token!r} (at position {at - len(token)})"
        mark, opened, parts, commas, after_comma = level = stack[-1]
        complete = bool(parts) and not after_comma
        if m[1] or token in _CLOSES:
            if complete:
                fail(f"unexpected {where} following a complete expression")
            if token == "<" and any(x[0] == "<" for x in stack):
                fail(f"{token!r} (at position {at - 1}) is nested in another '<'")
            if m[1]:
                level[2], level[4] = [*parts, Name(token)], False
            else:
                stack.append([token, at - 1, [], False, False])
        elif token == ",":
            if after_comma:
                fail(f"unexpected {where} immediately following another ','")
            if not parts:
                fail(f"unexpected {where} with no preceding expression")
            level[3] = level[4] = True
        else:
            if not mark or not any(_CLOSES.get(x[0]) == token for x in stack):
                opener = next(o for o, c in _CLOSES.items() if c == token)
                expected = f"; expected {_CLOSES[mark]!r}" if mark else ""
                fail(f"unexpected {where} with no matching {opener!r}{expected}")
            if _CLOSES[mark] != token:
                fail(f"unexpected {where}; expected {_CLOSES[mark]!r}")
            if mark == "<" and not parts:
                fail(f"there is no expression between '<' (at position {opened}) and {where}")
            stack.pop()
            inner = Group(tuple(parts)) if commas or not parts else parts[0]
            level = stack[-1]
            level[2], level[4] = [*level[2], Draft(inner) if mark == "<" else inner], False
    mark, opened, parts, commas, _ = stack[-1]
    if mark:
        fail(f"{mark!r} (at position {opened}) has no matching {_CLOSES[mark]!r}")
    return Group(tuple(parts)) if commas else parts[0]


def entity_name(text: str) -> str:
    node = parse(text)
    if not isinstance(node, Name):
        raise ValueError(f"Expected a valid entity name, but got {text!r}")
    return node.name
