"""Loads process definitions from their XML form; name spaces are ignored."""

from __future__ import annotations

import pkgutil
import xml.etree.ElementTree as ET

from millrace.operators.conditions import And, Const, Holds, Is, Not, Or, Xor
from millrace.plans.model import ColumnFormat, DefinitionError, ErrorRoute, Hint, MapExpression, MapField, Network, Node, Pipe, ProcessDef, Resource, Route, StreamFormat, Task, Terminal


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def kids(e: ET.Element | None, name: str | None = None) -> list[ET.Element]:
    return [c for c in (e if e is not None else []) if name is None or tag(c) == name]


def kid(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next(iter(kids(e, name)), None)
    return e


def text(e: ET.Element | None, *path: str, default: str | None = None) -> str | None:
    e = kid(e, *path)
    return default if e is None else e.text or ""


def quotes(e: ET.Element | None) -> tuple[tuple[str, str], ...] | None:
    found = []
    for q in kids(e, "quotes"):
        both = text(q, "quotes")
        found.append((both, both) if both is not None else (text(q, "start"), text(q, "end")))
    return tuple(found) or None


def stream_format(e: ET.Element | None, shared: dict[str, ET.Element]) -> StreamFormat | None:
    """A terminal's own format, or the shared one that it refers to."""
    ref = text(e, "formatRef")
    if ref is not None:
        if ref.strip() not in shared:
            raise DefinitionError(f"no format {ref.strip()!r}")
        found = shared[ref.strip()]
    else:
        found = kid(e, "format")
    if found is not None and kid(found, "tableFormat") is not None:
        columns = kids(kid(found, "tableFormat", "fields"), "column")
        return StreamFormat(tuple(c.get("name") for c in columns), types={c.get("name"): int(c.get("jdbcDataType")) for c in columns if c.get("jdbcDataType")})
    if found is not None and kid(found, "tmpFormat") is not None:
        return StreamFormat(view=True)
    e = kid(found, "streamFormat")
    if e is None:
        return None
    columns = {}
    for c in kids(kid(e, "columnFormatting"), "column"):
        delimiter, escape = [x.text for x in kids(c, "columnDelimiter")], [x.text for x in kids(c, "escape")]
        columns[c.get("columnRef")] = ColumnFormat(quotes(c), tuple(delimiter) or None, tuple(escape) or None)
    fields = tuple(c.get("name") for c in kids(kid(e, "fields"), "column"))
    default = quotes(e)
    return StreamFormat(fields, text(e, "separator", default="|"), text(e, "escape", default="\\"), default or (), columns, (text(e, "encoding", default="UTF-8")).strip(), text(e, "newline", default="\n"))


def parameters(e: ET.Element | None) -> dict[str, str]:
    found = kid(e, "parameters")
    return dict(found.attrib) if found is not None else {}


def mappings(e: ET.Element) -> tuple:
    out = []
    for c in kids(e):
        if tag(c) == "mapField":
            out.append(MapField(c.get("source"), c.get("destination")))
        elif tag(c) == "mapExpression":
            out.append(MapExpression(c.get("expression")))
    return tuple(out)


def resource(e: ET.Element | None) -> Resource | None:
    """What a terminal is bound to: a file, or a table of a database."""
    e = kid(e, "ioResource")
    if e is None:
        return None
    file, db = kid(e, "file"), kid(e, "db")
    if (file is None) == (db is None):
        raise DefinitionError(f"resource {e.get('name')}: a file or a table is needed")
    return Resource(e.get("name"), *(("file", file.get("location")) if db is None else ("db", db.get("connection"), db.get("table"))))


def terminal(e: ET.Element, shared: dict[str, ET.Element]) -> Terminal:
    hints = tuple(Hint(h.get("field"), text(h, "name") or text(h, "conversionMethod") or None, None, parameters(h)) for h in kids(e, "conversionHint"))
    errors = tuple(ErrorRoute(text(r, "destination"), mappings(r)) for r in kids(e, "errorRoute"))
    source = kid(e, "datasource") if kid(e, "datasource") is not None else kid(e, "datasink")
    return Terminal(e.get("name"), stream_format(source, shared), hints, errors, int(e.get("queueSize", 5000)), int(e.get("monitorFrequency", 0)), resource(source))


def condition(e: ET.Element):
    many = {"and": And, "or": Or, "xor": Xor}
    name = tag(e)
    if name in many:
        return many[name](tuple(condition(c) for c in kids(e)))
    if name == "not":
        return Not(condition(kids(e)[0]))
    if name == "true":
        return Const(True)
    if name == "predicate":
        event = kid(e, "eventType")
        if event is not None:
            return Is(event.text.strip())
        instance = kid(e, "objectInstance")
        if instance is not None:
            return Holds(text(instance, "class", default="").rpartition(".")[2], None, parameters(instance))
    raise DefinitionError(f"a condition cannot be {name!r}")


def embedded(e: ET.Element, nets: dict[str, ET.Element], within: tuple[str, ...]) -> Network:
    """A network inside a task: its own, or a named one of the document."""
    ref = text(e, "processingNetworkRef")
    found = kid(e, "processingNetwork") if ref is None else nets.get(ref.strip())
    if found is None:
        raise DefinitionError(f"no network {ref!r}")
    if ref is not None:
        if ref.strip() in within:
            raise DefinitionError(f"network {ref.strip()} holds itself")
        within += (ref.strip(),)
    ends = {k: {m.get("recordName"): mappings(m) for m in kids(e, f"{k}RecordMapping")} for k in ("input", "output")}
    for k, given in ends.items():
        names = {x.text.strip() for x in kids(kid(found, "io"), f"{k}Ref")}
        if names != set(given) or not names:
            raise DefinitionError(f"a network's {k}s are {', '.join(sorted(names)) or 'missing'}; mapped are {', '.join(sorted(given)) or 'none'}")
    return Network(ends["input"], ends["output"], *inside(found, nets, within))


def inside(e: ET.Element, nets: dict[str, ET.Element], within: tuple[str, ...] = ()) -> tuple[tuple[Route, ...], tuple[Node, ...], tuple[Pipe, ...]]:
    """Routes, nodes and pipes of a network."""
    pipes = tuple(Pipe(x.get("name"), int(x.get("monitorFrequency", 0))) for x in kids(kid(e, "io"), "asyncPipe"))
    return tuple(route(r) for r in kids(e, "route")), tuple(node(n, nets, within) for n in kids(e, "node")), pipes


def node(e: ET.Element, nets: dict[str, ET.Element], within: tuple[str, ...] = ()) -> Node:
    record = lambda name: {c.get("name"): c.get("javaType", "java.lang.String") for c in kids(kid(e, name), "column")}
    tasks = []
    for c in kids(kid(e, "tasks")):
        if tag(c) == "network":
            tasks.append(embedded(c, nets, within))
            continue
        function = ".".join(x for x in (text(c, "class"), text(c, "method")) if x)
        outputs = tuple((o.get("variable") or o.get("field"), o.get("field")) for o in kids(c, "output"))
        tasks.append(Task(function, tuple(i.get("field") for i in kids(c, "input")), outputs, parameters(c)))
    return Node(e.get("name"), record("receivedFields"), record("createdFields"), tuple(tasks), int(e.get("monitorFrequency", 0)))


def route(e: ET.Element) -> Route:
    c = kid(e, "condition")
    return Route(text(e, "source").strip(), text(e, "destination").strip(), mappings(e), condition(kids(c)[0]) if c is not None else None)


def process(e: ET.Element, shared: dict[str, ET.Element], nets: dict[str, ET.Element]) -> ProcessDef:
    terminals, network = kid(e, "terminals"), kid(e, "network")
    io = kid(network, "io")
    used = lambda name: [x.text.strip() for x in kids(io, name)]
    inputs = {t.get("name"): terminal(t, shared) for t in kids(terminals, "input")}
    outputs = {t.get("name"): terminal(t, shared) for t in kids(terminals, "output")}
    for name in used("inputRef") + used("outputRef"):
        if name not in inputs and name not in outputs:
            raise DefinitionError(f"no terminal {name!r}")
    return ProcessDef(e.get("name"), tuple(inputs[n] for n in used("inputRef")), tuple(outputs[n] for n in used("outputRef")), *inside(network, nets))


def exports(path: str) -> None:
    """Imports a descriptor's classes (or whole modules); whatever they register can be named in definitions."""
    for e in ET.parse(path).getroot().iter():
        if tag(e) == "class":
            name = (e.text or "").strip()
            try:
                pkgutil.resolve_name(name)
            except (ValueError, ImportError, AttributeError) as fault:
                raise DefinitionError(f"{path}: no {name!r}: {fault}") from fault


def load(xml: str) -> dict[str, ProcessDef]:
    """All processes of a definitions document, by name."""
    every = list(ET.fromstring(xml).iter())
    shared = {e.get("name"): e for e in every if tag(e) == "format" and e.get("name")}
    nets = {e.get("name"): e for e in every if tag(e) in ("network", "processingNetwork") and e.get("name")}
    return {e.get("name"): process(e, shared, nets) for e in every if tag(e) == "process"}
