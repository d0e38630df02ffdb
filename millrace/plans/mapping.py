"""Mapping expressions: what the fields of a destination record are made of.

    * = received:                 every field from that record
    * - (a + b) = created:        all but some
    f = g      f = received:g     one field, renamed if need be
    f = java.lang.Integer {x + 1} a typed SQL expression over the fields
    f = {x + 1}                   the same, with the type inferred

Definitions are separated by commas; a later one overrides an earlier one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from millrace.plans.model import Compat, DefinitionError, MapField

NAME = r"[A-Za-z_][\w\-]*"
RECORDS = ("received", "created", "error", "nodedata")


@dataclass(frozen=True)
class FromRecord:
    record: str


@dataclass(frozen=True)
class FromField:
    record: str | None
    field: str


@dataclass(frozen=True)
class FromExpression:
    type: str | None
    sql: str


@dataclass(frozen=True)
class Definition:
    every: bool  # starts from the wildcard
    plus: tuple[str, ...]
    minus: tuple[str, ...]
    source: object


def split_top(text: str) -> list[str]:
    """Parts between commas that stand in no bracket or brace."""
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c in "({") - (c in ")}")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now]]


def field_set(text: str, compat: Compat) -> tuple[bool, tuple[str, ...], tuple[str, ...]]:
    """(from the wildcard, fields added, fields removed) of the left side."""
    text = text.strip()
    text = "*" + text[4:] if text.startswith("@all") else text
    if text.startswith("@(") and text.endswith(")"):
        text = text[2:-1].strip()
        text = "*" + text[3:] if text.startswith("all") else text
    if not re.fullmatch(rf"(\*|{NAME})(\s+[+-]\s+[\w\s+\-()]+)?|\*\s*[+-][\w\s+\-()]+|\*", text):
        raise DefinitionError(f"mapping: cannot read {text!r}")
    parts = re.findall(rf"[()]|(?<!\w)[+-]|{NAME}|\*", text)
    plus: list[str] = []
    minus: list[str] = []
    every = parts[0] == "*"
    if not every:
        plus.append(parts[0])
    signs, sign = [1], 1
    for t in parts[1:]:
        if t == "(":
            signs.append(signs[-1] * sign)
            sign = 1
        elif t == ")":
            signs.pop()
            sign = 1
        elif t in "+-":
            sign = 1 if t == "+" else -1
        else:
            adds = signs[-1] * sign > 0 and not (compat.plus_removes_fields and every)
            (plus if adds else minus).append(t)
    return every, tuple(x for x in plus if x not in minus), tuple(minus)


def source(text: str) -> object:
    text = text.strip()
    if m := re.fullmatch(r"([^{}]*)\{([^{}]*)\}", text, re.S):
        return FromExpression(m[1].strip() or None, m[2].strip())
    if m := re.fullmatch(r"(\w+):", text):
        if m[1] not in RECORDS:
            raise DefinitionError(f"mapping: no record {m[1]!r}")
        return FromRecord(m[1])
    if m := re.fullmatch(rf"(?:(\w+):)?({NAME})", text):
        if m[1] and m[1] not in RECORDS:
            raise DefinitionError(f"mapping: no record {m[1]!r}")
        return FromField(m[1], m[2])
    raise DefinitionError(f"mapping: cannot read {text!r}")


def parse(text: str, compat: Compat = Compat()) -> list[Definition]:
    out = []
    for part in split_top(text):
        left, eq, right = part.partition("=")
        if not eq:
            raise DefinitionError(f"mapping: {part!r} has no equals sign")
        out.append(Definition(*field_set(left, compat), source(right)))
    return out


def renamed(mappings: tuple, have: list[str], compat: Compat = Compat()) -> dict[str, str]:
    """Which field of one record goes where: destination to source. No mapping: all keep their names."""
    out: dict[str, str] = {} if mappings else {f: f for f in have}
    for mp in mappings:
        if isinstance(mp, MapField):
            out[mp.destination] = mp.source.rpartition(":")[2]
            continue
        for d in parse(mp.expression, compat):
            if isinstance(d.source, FromExpression):
                raise DefinitionError(f"{mp.expression!r}: fields of an embedded network are not computed")
            names = [*(have if d.every else ()), *d.plus]
            out |= {n: d.source.field if isinstance(d.source, FromField) else n for n in names if n not in d.minus}
    for source in out.values():
        if source not in have:
            raise DefinitionError(f"no field {source!r} to map")
    return out
