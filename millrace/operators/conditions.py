"""Route conditions: boolean trees over events and predicates, as Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.predicates import holds
from millrace.plans.model import DELIVERED, EVENTS, META_OK, DefinitionError


@dataclass(frozen=True)
class Is:
    event: str


@dataclass(frozen=True)
class Holds:
    """A registered predicate over one field of the record."""

    predicate: str
    value: str | None = None
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Const:
    value: bool = True


@dataclass(frozen=True)
class And:
    of: tuple


@dataclass(frozen=True)
class Or:
    of: tuple


@dataclass(frozen=True)
class Xor:
    """True for an odd number of true parts."""

    of: tuple


@dataclass(frozen=True)
class Not:
    of: object


#: A route without a condition takes records that are all right.
DEFAULT = Is("meta:ok")


def build(condition, delivered: Column, lookup) -> Column:
    """lookup(name) gives a field's Column; delivered stands for its event."""
    def go(c) -> Column:
        if isinstance(c, Is):
            event = EVENTS.get(c.event, c.event)
            if event not in EVENTS.values():
                raise DefinitionError(f"no event {c.event!r}")
            return delivered if event == DELIVERED else F.array_contains("events", event)
        if isinstance(c, Holds):
            return holds(c.predicate, lookup(c.value) if c.value else F.lit(None).cast("string"), c.parameters)
        if isinstance(c, Const):
            return F.lit(c.value)
        if isinstance(c, Not):
            return ~go(c.of)
        parts = [go(x) for x in c.of]
        if not parts:
            raise DefinitionError("a condition has no parts")
        return reduce({And: lambda a, b: a & b, Or: lambda a, b: a | b, Xor: lambda a, b: a != b}[type(c)], parts)

    return F.coalesce(go(condition), F.lit(False))


def start_events() -> Column:
    return F.array(F.lit(META_OK))


def add_event(events: Column, event: str, when: Column, keep_ok: bool) -> Column:
    base = events if keep_ok else F.array_remove(events, META_OK)
    return F.when(when, F.array_union(base, F.array(F.lit(event)))).otherwise(events)
