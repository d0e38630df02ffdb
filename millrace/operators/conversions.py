"""Type conversions of terminal fields.

A conversion gives a value and whether it worked; it never fails a Spark job.
Hints come first, then equal types, then conversions registered for the two
types, then the string form; else the definition is in error.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.predicates import as_int
from millrace.plans.model import DefinitionError, Hint

DEFAULT_DATE = "yyyy.MM.dd HH:mm:ss"
Conversion = Callable[[Column, dict], tuple[Column, Column]]
BY_NAME: dict[str, Conversion] = {}
BY_TYPE: dict[tuple[str, str], str] = {}


def conversion(name: str, source: str | None = None, target: str | None = None):
    """Registers a conversion by name and, if given, by its types."""

    def add(f: Conversion) -> Conversion:
        BY_NAME[name] = f
        if source and target:
            BY_TYPE[source, target] = name
        return f

    return add


def date_pattern(p: str) -> str:
    """An older date pattern in Spark's letters: zones Z... are xx; runs of day names are
    cut to what Spark allows; quoted text stays."""
    out = []
    for quoted, run, _ in re.findall(r"('(?:[^']|'')*')|((.)\3*)", p):
        if quoted:
            out.append(quoted)
        elif run[0] == "Z":
            out.append("xx")
        elif run[0] == "a":
            out.append("a")
        elif run[0] == "E":
            out.append("E" if len(run) < 4 else "EEEE")
        elif run[0] == "X":
            out.append({1: "X", 2: "XX"}.get(len(run), "XXX"))
        elif run[0] == "u":
            raise DefinitionError(f"date pattern {p!r}: the number of a weekday cannot be read or written")
        else:
            out.append(run)
    return "".join(out)


@conversion("string2int", "string", "int")
def string2int(v: Column, p: dict) -> tuple[Column, Column]:
    n = as_int(v)
    if "default" in p:
        return F.coalesce(n, F.lit(int(p["default"]))), F.lit(True)
    return n, n.isNotNull()


@conversion("int2string", "int", "string")
def int2string(v: Column, p: dict) -> tuple[Column, Column]:
    return v.cast("string"), v.isNotNull()


@conversion("string2date", "string", "timestamp")
def string2date(v: Column, p: dict) -> tuple[Column, Column]:
    t = F.try_to_timestamp(v, F.lit(date_pattern(p.get("format", DEFAULT_DATE))))
    return t, v.isNull() | t.isNotNull()


@conversion("date2string", "timestamp", "string")
def date2string(v: Column, p: dict) -> tuple[Column, Column]:
    return F.date_format(v, date_pattern(p.get("format", DEFAULT_DATE))), v.isNotNull()


@conversion("exportException", "struct<class:string,message:string,stack:string>", "string")
def export_exception(v: Column, p: dict) -> tuple[Column, Column]:
    part = lambda c: F.coalesce(v[c], F.lit(""))
    text = F.concat(F.lit("Exception "), part("class"), F.lit(" Message: "), part("message"), F.lit(" Stack trace: "), part("stack"))
    return F.when(v.isNotNull(), F.translate(text, "\n", ";")), F.lit(True)


def to_string(v: Column, kind: str) -> Column:
    """The string form of any value."""
    if kind.startswith("struct"):
        return v.cast("string")
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ", "), F.lit("]"))
    return v.cast("string")


#: Methods of a value that can be named as conversions; null stays null (names are fixed values).
METHODS: dict[str, Callable[[Column], Column]] = {
    "toString": lambda v: v.cast("string"), "trim": F.trim, "toLowerCase": F.lower, "toUpperCase": F.upper, "length": F.length,
    "intValue": lambda v: v.try_cast("int"), "longValue": lambda v: v.try_cast("long"), "doubleValue": lambda v: v.try_cast("double"), "booleanValue": lambda v: v.try_cast("boolean"),
}


def by_name(name: str) -> Conversion:
    """A registered conversion by its name or, with a path, by the path's last word; a
    method of the value; or `module.function`, `module.Class.method` of Python: a static
    method of one Column, or a method of an instance that is made with the parameters."""
    if name in BY_NAME:
        return BY_NAME[name]
    path, _, last = name.rpartition(".")
    found = _python(name) if path else None
    if found is not None:
        return found
    if last in BY_NAME:
        return BY_NAME[last]
    if last in METHODS:
        return lambda v, p: (METHODS[last](v), v.isNull() | METHODS[last](v).isNotNull())
    raise DefinitionError(f"no conversion {name!r}")


def _python(name: str) -> Conversion | None:
    """What a Python path leads to, as a conversion; None if it leads nowhere."""
    parts = name.split(".")
    for cut in range(len(parts) - 1, 0, -1):
        module = ".".join(parts[:cut])
        try:
            at = importlib.import_module(module)
        except ModuleNotFoundError as e:
            if e.name and (module == e.name or module.startswith(e.name + ".")):
                continue
            raise
        owner = None
        for x in parts[cut:]:
            owner, at = at, getattr(at, x, None)
        if at is None:
            return None
        bound = isinstance(owner, type) and not isinstance(owner.__dict__.get(parts[-1]), staticmethod)

        def run(v: Column, p: dict) -> tuple[Column, Column]:
            got = getattr(owner(p) if p else owner(), parts[-1])(v) if bound else at(v)
            return got, v.isNull() | got.isNotNull()

        return run
    return None


def convert(v: Column, source: str, target: str, hint: Hint | None = None) -> tuple[Column, Column]:
    if hint is not None:
        if callable(hint.method):
            got = hint.method(v)
            return got, v.isNull() | got.isNotNull()
        return by_name(hint.name)(v, hint.parameters)
    if source == target:
        return v, F.lit(True)
    if (source, target) in BY_TYPE:
        return BY_NAME[BY_TYPE[source, target]](v, {})
    if target == "string":
        return to_string(v, source), F.lit(True)
    raise DefinitionError(f"no conversion from {source} to {target}")
