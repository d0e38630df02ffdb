"""Process definitions: terminals, nodes, routes and what they are made of."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Events a record can carry.
META_OK = "META_OK"
DELIVERED = "ROUTING_RECORD_HAS_BEEN_DELIVERED"
#: Names in process definitions (fixed values).
EVENTS = {
    "meta:ok": META_OK,
    "error:stream-parse-exception": "ERROR_STREAM_PARSE_EXCEPTION",
    "error:task-exception": "ERROR_TASK_EXCEPTION",
    "error:task-failed": "ERROR_TASK_FAILED",
    "error:event-evaluation-exception": "ERROR_EVENT_EVALUATION_EXCEPTION",
    "error:io-exception": "ERROR_IO_EXCEPTION",
    "error:conversion-failed": "ERROR_CONVERSION_FAILED",
    "routing:record-has-been-delivered": DELIVERED,
}


class DefinitionError(ValueError):
    """A process definition that cannot be planned."""


@dataclass(frozen=True)
class Compat:
    """Switches back to questionable behaviour of older definitions' engine."""

    keep_ok_on_error: bool = False
    plus_removes_fields: bool = False
    right_associative: bool = False


@dataclass(frozen=True)
class ColumnFormat:
    """None keeps the format's own setting; a value replaces it."""

    quotes: tuple[tuple[str, str], ...] | None = None
    delimiters: tuple[str, ...] | None = None
    escapes: tuple[str, ...] | None = None
    separators: tuple[str, ...] | None = None


@dataclass(frozen=True)
class StreamFormat:
    fields: tuple[str, ...] = ()
    separator: str = "|"
    escape: str = "\\"
    quotes: tuple[tuple[str, str], ...] = (('"', '"'),)
    columns: dict[str, ColumnFormat] = field(default_factory=dict)
    encoding: str = "UTF-8"
    newline: str = "\n"
    types: dict[str, int] = field(default_factory=dict)  # of tables: JDBC type codes
    view: bool = False  # a temporary view under the terminal's name, with its own columns


#: What an output without a format of its own writes.
DEFAULT_SINK = StreamFormat(quotes=())


@dataclass(frozen=True)
class Hint:
    """How one terminal field is converted: a registered name, or a callable of a Column."""

    field: str
    name: str | None = None
    method: object | None = None
    parameters: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class MapField:
    source: str
    destination: str


@dataclass(frozen=True)
class MapExpression:
    expression: str


@dataclass(frozen=True)
class ErrorRoute:
    destination: str
    mappings: tuple = ()


@dataclass(frozen=True)
class Resource:
    """What a terminal is bound to: `file` at a location, or `db` by connection and table."""

    name: str
    kind: str
    location: str
    table: str | None = None


@dataclass(frozen=True)
class Terminal:
    name: str
    format: StreamFormat | None = None
    hints: tuple[Hint, ...] = ()
    error_routes: tuple[ErrorRoute, ...] = ()
    queue_size: int = 5000
    monitor_frequency: int = 0
    resource: Resource | None = None


@dataclass(frozen=True)
class Task:
    """A registered function: its inputs are received fields, its outputs (variable, created field)."""

    function: str
    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]
    parameters: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Virtual:
    """An entry or exit of an embedded network: what goes in comes out, in its types.
    An exit takes its fields from the first route that leads there."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    format: None = None
    hints: tuple = ()
    error_routes: tuple = ()


@dataclass(frozen=True)
class Network:
    """A network as a task. A record of the node goes to every entry, with the received
    fields that its mappings name; every record that comes to an exit leaves the node,
    with the created fields that the exit's mappings set. One that comes to no exit is
    gone, as at any element; one that comes to two leaves twice."""

    inputs: dict[str, tuple]
    outputs: dict[str, tuple]
    routes: tuple[Route, ...]
    nodes: tuple[Node, ...] = ()
    pipes: tuple[Pipe, ...] = ()


@dataclass(frozen=True)
class Node:
    name: str
    received: dict[str, str]
    created: dict[str, str] = field(default_factory=dict)
    tasks: tuple[Task | Network, ...] = ()
    monitor_frequency: int = 0


@dataclass(frozen=True)
class Pipe:
    name: str
    monitor_frequency: int = 0


@dataclass(frozen=True)
class Route:
    source: str  # a node-set expression
    destination: str
    mappings: tuple = ()
    condition: object | None = None


@dataclass(frozen=True)
class ProcessDef:
    name: str
    inputs: tuple[Terminal, ...]
    outputs: tuple[Terminal, ...]
    routes: tuple[Route, ...]
    nodes: tuple[Node, ...] = ()
    pipes: tuple[Pipe, ...] = ()


#: Type names of definitions, and Spark's (fixed values).
TYPES = {
    "java.lang.String": "string", "java.lang.Character": "string", "java.lang.Integer": "int", "int": "int", "java.lang.Long": "bigint", "long": "bigint",
    "java.lang.Float": "float", "float": "float", "java.lang.Double": "double", "double": "double", "java.lang.Boolean": "boolean", "boolean": "boolean",
    "java.util.Date": "timestamp", "String": "string", "Integer": "int", "Long": "bigint", "Double": "double", "Boolean": "boolean", "Date": "timestamp",
}


#: Names of collections (fixed values); their parts stand in angle brackets.
LISTS = {"java.util.List", "java.util.ArrayList", "java.util.Set", "java.util.Collection", "List", "Set"}
MAPS = {"java.util.Map", "java.util.HashMap", "Map"}


def spark_type(name: str) -> str:
    """A definition's type name as a Spark type: `x[]` and lists are arrays, a wildcard
    is its bound, or else a string; Spark's own names pass."""
    name = name.strip()
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    if name.startswith("?"):
        return spark_type(re.sub(r"\A\?\s*(?:extends|super)?\s*", "", name) or "string")
    outer, _, rest = name.partition("<")
    if rest and outer.strip() in LISTS | MAPS:
        if not rest.endswith(">"):
            raise DefinitionError(f"type {name!r}: a bracket is open")
        parts, depth = [""], 0
        for c in rest[:-1]:
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                parts.append("")
            else:
                parts[-1] += c
        if len(parts) != (2 if outer.strip() in MAPS else 1):
            raise DefinitionError(f"type {name!r} has {len(parts)} parts")
        return f"{'map' if outer.strip() in MAPS else 'array'}<{','.join(map(spark_type, parts))}>"
    return TYPES.get(name, name)
