"""A resolved network as a DAG of DataFrames.

Every element is one DataFrame with columns received, created, error, nodedata
(structs) and events. Its routes are tried in their declared order; whether an
earlier one took the record is a running boolean, since conditions may ask for
it. Branches that lead to one element are united. Nothing here shuffles, and
nothing fails a job: errors are data. The same plan runs in batch and streaming.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.conditions import add_event, build, start_events
from millrace.operators.conversions import convert, export_exception, to_string
from millrace.operators.records import record_to_string
from millrace.operators.tasks import EXCEPTION, called, known, run_task
from millrace.plans import mapping as m
from millrace.plans.analyzer import Resolved, ResolvedRoute, analyze
from millrace.plans.model import Compat, DefinitionError, MapExpression, MapField, Network, Node, Pipe, ProcessDef, Terminal, Virtual
from millrace.sources.formats import parse_lines


@dataclass
class Plan:
    """sinks: by output, its columns as strings. errors: by terminal, rows whose
    conversion failed. discarded: by input, lines that could not be read.
    elements and deliveries: what the counters of a monitor count."""

    resolved: Resolved
    sinks: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, DataFrame] = field(default_factory=dict)
    discarded: dict[str, DataFrame] = field(default_factory=dict)
    elements: dict[str, DataFrame] = field(default_factory=dict)
    deliveries: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    observed: dict[tuple[str, str, str], Observation] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Lets go of the rows that are kept for several routes."""
        while self.kept:
            self.kept.pop().unpersist()


def struct_of(fields: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items())) if fields else F.struct(F.lit(None).cast("string").alias("_"))


class Planner:
    def __init__(self, resolved: Resolved, persist: bool = True, observe: bool = False, carry: tuple[str, ...] = ()):
        """carry: columns that come along with every record, as those of the node around an embedded network."""
        self.r, self.persist, self.observe, self.carry = resolved, persist, observe, carry
        ends = {t.name for t in resolved.process.outputs}
        while more := {x.source for x in resolved.routes if x.destination in ends} - ends:
            ends |= more
        self.flows = ends  # elements from which records can come to a sink
        self.plan = Plan(resolved)
        self.into: dict[str, list[DataFrame]] = {e: [] for e in resolved.elements}

    def run(self, sources: dict[str, DataFrame]) -> Plan:
        """sources: by input, a DataFrame of lines (one column `line`) or of the input's string columns."""
        for name in self.r.order:
            e = self.r.elements[name]
            if isinstance(e, Node):
                df = self._node(e, self._union(name))
            elif isinstance(e, Pipe):
                df = self._union(name)
                df = df and self._framed(df.withColumn("created", F.col("received")), e.name, "pipe")
            elif name in {t.name for t in self.r.process.outputs}:
                self._sink(e, self._union(name))
                continue
            else:
                if name not in sources:
                    raise DefinitionError(f"nothing to read for input {name}")
                df = self._source(e, sources[name])
            if df is not None:
                df = self._counted(df, "element", name)
                self.plan.elements[name] = df
                self._send(name, df)
        return self.plan

    def _counted(self, df: DataFrame, kind: str, source: str, destination: str = "") -> DataFrame:
        """df, whose rows are counted by the run that writes the sinks."""
        if not self.observe or df.isStreaming or (destination or source) not in self.flows:
            return df
        got = self.plan.observed[kind, source, destination] = Observation(f"{kind}:{source}:{destination}")
        return df.observe(got, F.count(F.lit(1)).alias("n"))

    def _union(self, name: str) -> DataFrame | None:
        parts = self.into[name]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _framed(self, df: DataFrame, name: str, kind: str, events: Column | None = None, ex: Column | None = None) -> DataFrame:
        """The five columns of an element's records."""
        df = df.withColumn("nodedata", F.struct(F.lit(name).alias("name"), F.lit(kind).alias("nodeClass")))
        df = df.withColumn("events", start_events() if events is None else events)
        failed = F.exists("events", lambda x: x.startswith("ERROR_"))
        error = F.struct((F.lit(None).cast(EXCEPTION) if ex is None else ex).alias("ex"), "received", "created", "nodedata", "events")
        return df.withColumn("error", F.when(failed, error)).select("received", "created", "error", "nodedata", "events", *self.carry)

    def _source(self, t: Terminal | Virtual, df: DataFrame) -> DataFrame:
        if isinstance(t, Virtual):
            return self._framed(df.withColumn("created", F.col("received")), t.name, "source")
        if df.columns == ["line"] or ("line" in df.columns and not set(t.format.fields) <= set(df.columns)):
            parsed = parse_lines(df, t.format)
            self.plan.discarded[t.name] = parsed.filter("NOT fine").select(*[c for c in ("file", "line_no") if c in df.columns], F.lit("Parse Error").alias("reason"), "line")
            df = parsed.filter("fine").select("received")
        else:
            df = df.select(struct_of({f: F.col(f).cast("string") for f in t.format.fields}).alias("received"))
        hints = {h.field: h for h in t.hints}
        values, oks = {}, []
        for name, kind in self.r.created[t.name].items():
            value, ok = convert(F.col(f"received.{name}"), "string", kind, hints.get(name))
            values[name] = value.cast(kind)
            oks.append(F.coalesce(ok, F.lit(False)))
        fine = reduce(lambda a, b: a & b, oks, F.lit(True))
        # one bad field blanks the whole record
        created = struct_of({k: F.when(F.col("_ok"), v) for k, v in values.items()})
        df = df.withColumn("_ok", fine).withColumn("created", created)
        events = add_event(start_events(), "ERROR_CONVERSION_FAILED", ~F.col("_ok"), self.r.compat.keep_ok_on_error)
        df = self._framed(df, t.name, "source", events)
        self._error_routes(t, df.filter(F.array_contains("events", "ERROR_CONVERSION_FAILED")))
        return df

    def _error_routes(self, t: Terminal, failed: DataFrame) -> None:
        if t.error_routes:
            self.plan.errors[t.name] = failed

    def _node(self, n: Node, df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        df = df.withColumn("_events", start_events()).withColumn("_ex", F.lit(None).cast(EXCEPTION))
        kinds, keep = self.r.created[n.name], self.r.compat.keep_ok_on_error
        for name, kind in kinds.items():
            df = df.withColumn(f"_c_{name}", F.lit(None).cast(kind))
        for i, task in enumerate(n.tasks):
            if isinstance(task, Network):
                df = self._network(n, i, df)
                continue
            inputs, native = [F.col(f"received.{f}") for f in task.inputs], known(task.function).native
            if not native:
                df = df.withColumn(f"_r{i}", called(task.function, task.parameters, inputs))
            got, ok, ex = run_task(task.function, task.parameters, inputs, F.col(f"_r{i}"))
            # an exception ends the task sequence; what was set stays
            go = F.col("_ex").isNull()
            df = df.withColumn(f"_t{i}", F.struct(F.coalesce(ok, F.lit(True)).alias("ok"), ex.alias("ex"), *(c.alias(f"o_{k}") for k, c in got.items())))
            outputs = list(got)
            for k, (variable, target) in enumerate(task.outputs):
                source = variable if variable in got else outputs[k] if k < len(outputs) else None
                if source is None:
                    raise DefinitionError(f"node {n.name}: task {task.function} has no output {variable}")
                df = df.withColumn(f"_c_{target}", F.when(go & F.col(f"_t{i}.ex").isNull(), F.col(f"_t{i}.o_{source}").cast(kinds[target])))
            df = df.withColumn("_events", add_event(F.col("_events"), "ERROR_TASK_FAILED", go & ~F.col(f"_t{i}.ok"), keep))
            if not native:  # a native task throws nothing
                df = df.withColumn("_events", add_event(F.col("_events"), "ERROR_TASK_EXCEPTION", go & F.col(f"_t{i}.ex").isNotNull(), keep))
                df = df.withColumn("_ex", F.coalesce("_ex", F.when(go, F.col(f"_t{i}.ex"))))
        df = df.withColumn("created", struct_of({k: F.col(f"_c_{k}") for k in kinds}))
        df = self._framed(df, n.name, "node", F.col("_events"), F.col("_ex"))
        routes = sum(x.source == n.name for x in self.r.routes)
        if self.persist and routes > 1 and not df.isStreaming and any(not isinstance(t, Network) and not known(t.function).native for t in n.tasks):
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.plan.kept.append(df)
        return df

    def _network(self, n: Node, i: int, df: DataFrame) -> DataFrame:
        """Rows of the node as they come out of its network; rows with an exception go past it."""
        own, kinds, go = self.r.inner[n.name, i], self.r.created[n.name], F.col("_ex").isNull()
        inside = df.filter(go).select(F.struct(*df.columns).alias("_host"))
        got = Planner(own.network, self.persist, carry=("_host",)).run(
            {e: inside.select(struct_of({d: F.col(f"_host.received.{s}") for d, s in fields.items()}).alias("received"), "_host") for e, fields in own.entries.items()}
        )
        self.plan.kept += got.kept
        parts = [df.filter(~go)] if any(not isinstance(t, Network) and not known(t.function).native for t in n.tasks[:i]) else []
        for e, fields in own.exits.items():
            values = {c: F.col(f"_host.{c}") for c in df.columns} | {f"_c_{d}": F.col(f"received.{s}").cast(kinds[d]) for d, s in fields.items()}
            parts.append(got.sinks[e].select(*(v.alias(c) for c, v in values.items())))
        return reduce(DataFrame.unionByName, parts)

    def _send(self, name: str, df: DataFrame) -> None:
        routes = [x for x in self.r.routes if x.source == name]
        delivered = F.lit(False)
        for i, x in enumerate(routes):
            took = f"_d{i}"
            df = df.withColumn(f"_go{i}", build(x.condition, delivered, lambda f: self._value(name, f)))
            df = df.withColumn(took, delivered | F.col(f"_go{i}"))
            delivered = F.col(took)
        for i, x in enumerate(routes):
            to_sink = x.destination in {t.name for t in self.r.process.outputs if isinstance(t, Terminal)}
            values = {k: self._bound(b) for k, b in x.fields.items()}
            if to_sink:  # records of different sources may meet there
                values = {k: self._text(df, v) if (x.fields[k].type or "").startswith(("struct", "array")) else v for k, v in values.items()}
            branch = df.filter(F.col(f"_go{i}")).select(struct_of(values).alias("received"), *self.carry)
            branch = self._counted(branch, "route", x.source, x.destination)
            self.plan.deliveries[x.source, x.destination] = branch
            self.into[x.destination].append(branch)

    def _value(self, name: str, f: str) -> Column:
        record, _, f = f.rpartition(":")
        records = {"created": self.r.created[name] or {}, "received": self.r.received[name] or {}}
        for rec in [record] if record else records:
            if f in records[rec]:
                return F.col(f"{rec}.{f}")
        raise DefinitionError(f"condition at {name}: no field {f}")

    @staticmethod
    def _text(df: DataFrame, v: Column) -> Column:
        """The string form of an exception, a record or an array."""
        kind = df.select(v.alias("v")).schema["v"].dataType
        if kind.simpleString() == EXCEPTION:
            return export_exception(v, {})[0]
        return record_to_string(v, kind) if isinstance(kind, StructType) else to_string(v, kind.simpleString())

    def _bound(self, b) -> Column:
        if b.sql is not None:
            got = F.expr(b.sql)
            return got.cast(b.type) if b.type else got
        return F.col(b.record)[b.field]

    def _sink(self, t: Terminal, df: DataFrame | None) -> None:
        if df is None:
            return
        df = self._counted(df, "element", t.name)
        self.plan.elements[t.name] = df
        if isinstance(t, Virtual):
            self.plan.sinks[t.name] = df
            return
        hints = {h.field: h for h in t.hints}
        kinds = {f.name: f.dataType.simpleString() for f in df.schema["received"].dataType.fields}
        values, oks = {}, []
        for name, kind in kinds.items():
            v = F.col(f"received.{name}")
            if name in hints:
                value, ok = convert(v, kind, "string", hints[name])
            elif kind == EXCEPTION:
                value, ok = export_exception(v, {})
            elif kind.startswith("struct"):
                value, ok = record_to_string(v, df.schema["received"].dataType[name].dataType), F.lit(True)
            else:
                value, ok = convert(v, kind, "string")
            values[name] = value
            oks.append(F.coalesce(ok, F.lit(False)))
        df = df.withColumn("_ok", reduce(lambda a, b: a & b, oks, F.lit(True)))
        self.plan.sinks[t.name] = df.filter("_ok").select(*(c.alias(k) for k, c in values.items()))
        if t.error_routes:
            self.plan.errors[t.name] = df.filter("NOT _ok").select("received")


def plan(process: ProcessDef, sources: dict[str, DataFrame], compat: Compat = Compat(), persist: bool = True, observe: bool = False) -> Plan:
    """persist keeps a node's rows where several routes leave it and its tasks run
    Python, so that a record's tasks run once; release() lets them go. observe counts
    the records of elements and routes while the sinks are written."""
    process, sources = viewed(process, sources)
    got = Planner(analyze(process, compat), persist, observe).run(sources)
    return error_sinks(got)


def viewed(process: ProcessDef, sources: dict[str, DataFrame]) -> tuple[ProcessDef, dict[str, DataFrame]]:
    """Inputs whose format is a temporary view get its columns and, unless one is given, its rows."""
    inputs = []
    for t in process.inputs:
        if t.format is not None and t.format.view:
            if t.name not in sources:
                sources = sources | {t.name: SparkSession.active().table(t.name)}
            t = replace(t, format=replace(t.format, fields=tuple(sources[t.name].columns)))
        inputs.append(t)
    return replace(process, inputs=tuple(inputs)), sources


def error_sinks(p: Plan) -> Plan:
    """Rows of terminals' error routes, mapped, under the name of the route's destination."""
    for t in [*p.resolved.process.inputs, *p.resolved.process.outputs]:
        failed = p.errors.get(t.name)
        if failed is None:
            continue
        for route in t.error_routes:
            record = failed.schema["received"].dataType
            kinds = {f.name: f for f in record.fields}
            out: dict[str, Column] = {}
            for mp in route.mappings:
                if isinstance(mp, MapField):
                    out[mp.destination] = F.col(f"received.{mp.source.split(':')[-1]}").cast("string")
                elif isinstance(mp, MapExpression):
                    for d in m.parse(mp.expression):
                        names = (list(kinds) if d.every else []) + list(d.plus)
                        out |= {n: F.col(f"received.{n}").cast("string") for n in names if n in kinds and n not in d.minus}
            out = out or {n: F.col(f"received.{n}").cast("string") for n in kinds}
            df = failed.select(*(c.alias(k) for k, c in out.items()))
            have = p.sinks.get(route.destination)
            p.sinks[route.destination] = df if have is None else have.unionByName(df, allowMissingColumns=True)
    return p


__all__ = ["Plan", "Planner", "ResolvedRoute", "plan"]
