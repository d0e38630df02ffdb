"""Predicates over one string value; a null value never holds, save for `true`.

A predicate is a function of a Column and its parameters, or a class: made without
arguments, it is told its parameters (setParameters), may refuse them (init gives
False), answers with isEvent(Column), and is closed. All but isEvent may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.plans.model import DefinitionError

Predicate = Callable[[Column, dict], Column]
PREDICATES: dict[str, Predicate] = {}


def predicate(name: str):
    def add(f: Predicate) -> Predicate:
        PREDICATES[name] = f
        return f

    return add


def holds(name: str, v: Column, params: dict) -> Column:
    """The named predicate over a value."""
    if name not in PREDICATES:
        raise DefinitionError(f"no predicate {name!r}")
    found = PREDICATES[name]
    if not isinstance(found, type):
        return found(v, params)
    made, step = found(), lambda method, *args: getattr(made, method, lambda *_: None)(*args)
    step("setParameters", params)
    if step("init") is False:
        raise DefinitionError(f"predicate {name} refuses {params}")
    try:
        return F.coalesce(made.isEvent(v), F.lit(False))
    finally:
        step("close")


def as_int(v: Column) -> Column:
    """An optional sign and digits that fit an int; null for anything else, blanks included."""
    s = v.cast("string")
    return F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("int"))


@predicate("numeric")
def numeric(v: Column, p: dict) -> Column:
    """comparisonResult -1, 0 or 1: below, equal to or above comparisonValue."""
    diff = F.signum(as_int(v).cast("long") - int(p["comparisonValue"]))
    return F.coalesce(diff == int(p["comparisonResult"]), F.lit(False))


def _text(test: Callable[[Column, str], Column]) -> Predicate:
    return lambda v, p: F.coalesce(test(v.cast("string"), p["comparisonValue"]), F.lit(False))


PREDICATES |= {
    "contains": _text(lambda v, x: v.contains(x)),
    "startsWith": _text(lambda v, x: v.startswith(x)),
    "endsWith": _text(lambda v, x: v.endswith(x)),
    "equals": _text(lambda v, x: v == x),
    "regexMatches": _text(lambda v, x: v.rlike(rf"\A(?:{x})\z")),
    "true": lambda v, p: F.lit(True),
}
