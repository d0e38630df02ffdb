"""Counters and reports of a run: records entering each element and taken by each route.

With plan(observe=True) the counts come from the run that writes the sinks itself;
counts() makes a pass of its own, for plans that are not run otherwise.
"""

from __future__ import annotations

import json
import logging
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.planner import Plan

log = logging.getLogger("millrace")
#: Calls for one counter; beyond that only its total is told.
TICKS = 1000


@dataclass
class Monitor:
    """Callbacks in the order of a run; the defaults do nothing."""

    on_start: Callable[[str], None] = lambda process: None
    on_node: Callable[[str, int], None] = lambda node, n: None
    on_route: Callable[[str, str, int], None] = lambda source, destination, n: None
    on_error: Callable[[str, int], None] = lambda where, n: None
    on_event: Callable[[str, str], None] = lambda kind, text: None
    on_input_finished: Callable[[str], None] = lambda name: None
    on_finish: Callable[[str], None] = lambda process: None
    events: list = field(default_factory=list)

    def custom(self, kind: str, text: str) -> None:
        """An event outside the counters, such as a file that cannot be opened."""
        self.events.append((kind, text))
        self.on_event(kind, text)


def log_monitor() -> Monitor:
    """The command line's monitor: all that happens goes to the log."""
    return Monitor(
        lambda p: log.info("process %s starts", p), lambda n, k: log.info("%s: %d records", n, k), lambda a, b, k: log.info("%s -> %s: %d records", a, b, k),
        lambda w, k: log.warning("%s: %d records in error", w, k), lambda kind, text: log.warning("%s: %s", kind, text), lambda n: log.info("input %s is read", n), lambda p: log.info("process %s is done", p),
    )


def counts(plan: Plan) -> DataFrame:
    """(kind, source, destination, n) of all elements and routes, as one small aggregate of its own."""
    spark = next(iter(plan.elements.values())).sparkSession
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("element").alias("kind"), F.lit(e).alias("source"), F.lit("").alias("destination"), "n") for e, df in plan.elements.items()]
    parts += [df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("route").alias("kind"), F.lit(a).alias("source"), F.lit(b).alias("destination"), "n") for (a, b), df in plan.deliveries.items()]
    out = parts[0] if parts else spark.createDataFrame([], "kind string, source string, destination string, n long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def observed(plan: Plan) -> list[dict]:
    """The counts that the run which wrote the sinks has left; call it after that run."""
    return [{"kind": kind, "source": a, "destination": b, "n": got.get["n"]} for (kind, a, b), got in plan.observed.items()]


def report(plan: Plan, monitor: Monitor = Monitor(), began: float | None = None) -> dict:
    """Calls back, and gives a report. Counts are those of the run that wrote the sinks, if it was observed; else they are counted now."""
    name, started = plan.resolved.process.name, began or time.time()
    monitor.on_start(name)
    rows = observed(plan) if plan.observed else [r.asDict() for r in counts(plan).collect()]  # one row for each element and route of the definition
    every = {e.name: getattr(e, "monitor_frequency", 0) for e in plan.resolved.elements.values()}
    for r in rows:
        tell = (lambda n, r=r: monitor.on_node(r["source"], n)) if r["kind"] == "element" else (lambda n, r=r: monitor.on_route(r["source"], r["destination"], n))
        step = every.get(r["source"], 0)
        if step and r["n"] // step <= TICKS:  # a call at each multiple of the element's frequency, as if counted along
            for k in range(1, r["n"] // step + 1):
                tell(k * step)
        else:
            tell(r["n"])
    for t in plan.resolved.process.inputs:
        monitor.on_input_finished(t.name)
    errors = {k: df.count() for k, df in {**plan.errors, **plan.discarded}.items()}
    for where, n in errors.items():
        monitor.on_error(where, n)
    monitor.on_finish(name)
    ended = time.time()
    return {
        "process": name, "started": datetime.fromtimestamp(started, UTC).isoformat(), "ended": datetime.fromtimestamp(ended, UTC).isoformat(), "seconds": ended - started,
        "terminals": {kind: {t.name: bound(t) for t in ts} for kind, ts in (("input", plan.resolved.process.inputs), ("output", plan.resolved.process.outputs))},
        "counts": rows, "errors": errors, "events": list(monitor.events),
    }


def bound(terminal) -> str | None:
    """A terminal's resource: file@location or db@connection,table."""
    r = terminal.resource
    return None if r is None else f"file@{r.location}" if r.kind == "file" else f"db@{r.location},{r.table}"


def report_json(plan: Plan) -> str:
    return json.dumps(report(plan), sort_keys=True)


def report_xml(got: dict, resources: dict[str, str] | None = None) -> str:
    """A report as a document: terminals with what they are bound to, the process, timing, counts. resources: by terminal, what the run bound."""
    root = ET.Element("report")
    terminals = ET.SubElement(root, "terminals")
    for kind, ts in got["terminals"].items():
        for name, at in ts.items():
            e = ET.SubElement(terminals, kind, name=name)
            if at := (resources or {}).get(name, at):
                ET.SubElement(e, "ioResource").text = at
    ET.SubElement(root, "process", name=got["process"])
    ET.SubElement(root, "timing", programStart=got["started"], programEnd=got["ended"])
    out = ET.SubElement(root, "counts")
    for r in got["counts"]:
        ET.SubElement(out, r["kind"], {k: str(v) for k, v in r.items() if k != "kind" and v != ""})
    for where, n in got["errors"].items():
        ET.SubElement(out, "error", at=where, n=str(n))
    for kind, text in got["events"]:
        ET.SubElement(out, "event", kind=kind).text = text
    return ET.tostring(root, encoding="unicode")
