"""Query suite of the record-processing engine: each operator over whole tables.

QUERIES and ORACLE_SQL have the same keys, save for queries that SQL cannot
express, which the tests hold against hand-derived rows.
"""

from __future__ import annotations

import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import netaddr, strings, url
from millrace.functions.useragent import FIELDS as UA_FIELDS
from millrace.functions.useragent import user_agent
from millrace.monitor import counts, observed
from millrace.operators import enrich, keyset, records
from millrace.operators.conditions import And, Const, Holds, Is, Not, Or, Xor
from millrace.operators.conversions import date2string, string2date
from millrace.operators.predicates import PREDICATES
from millrace.operators.tasks import native_task, python_task
from millrace.plans.model import ColumnFormat, ErrorRoute, Hint, MapExpression, MapField, Network, Node, Pipe, ProcessDef, Route, StreamFormat, Task, Terminal
from millrace.plans.planner import Plan, plan
from millrace.sources.files import as_strings, decoded, lines_of, read_lines, write_lines
from millrace.sources.formats import split_line
from millrace.sources.store import Store
from millrace.streaming.run import start

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def united(p: Plan) -> DataFrame:
    """All sinks in one DataFrame, by name."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("sink"), "*") for n, df in p.sinks.items()))


def source(name: str, *fields: str, **more) -> Terminal:
    return Terminal(name, StreamFormat(fields), **more)


def sinks(*names: str) -> tuple[Terminal, ...]:
    return tuple(Terminal(n) for n in names)


# --- tasks that the queries use -------------------------------------------------------


@native_task("upper")
def _upper(params, s):
    return F.upper(s)


@native_task("split_pair")
def _split_pair(params, s):
    """The parts before and after the first separator; a failure without one."""
    at = F.locate(params["separator"], s)
    return {"head": F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s), "tail": F.when(at > 0, F.substring(s, at + 1, F.length(s))), "ok": at > 0}


@native_task("first_word")
def _first_word(params, s):
    return F.split(s, " ")[0]


@python_task("strict_half", {"half": "int"})
def _strict_half(params, n):
    """Half of an even number; an odd one raises, a multiple of ten fails."""
    if n % 2:
        raise ValueError(f"odd: {n}")
    return {"half": n // 2, "ok": n % 10 != 0}


# --- routing ---------------------------------------------------------------------------

LOG = StreamFormat(("id", "hit_timestamp", "request", "user_id"), separator=" ", quotes=(), columns={"hit_timestamp": ColumnFormat(quotes=(("[", "]"),)), "request": ColumnFormat(quotes=(('"', '"'),))})
LOG_DATE = "dd/MMM/yyyy:HH:mm:ss ZZZZZ"


def log_lines(events: DataFrame) -> DataFrame:
    """An access log of the events."""
    quoted = F.regexp_replace(F.concat_ws(" ", "event_type", "props"), '(["\\\\])', "\\\\$1")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss xx")
    return events.select(F.concat(F.col("event_id").cast("string"), F.lit(" ["), stamp, F.lit('] "'), quoted, F.lit('" '), F.col("user_id").cast("string")).alias("line"))


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'rest' ELSE 'fact' END AS sink, event_id::VARCHAR AS id,
  strftime(ts, '%Y.%m.%d %H:%M:%S') || ' (+0000)' AS hit_timestamp, event_type AS kind, user_id::VARCHAR AS user_id
FROM events""")
def log_pipeline(spark, sf):
    """Lines to typed fields, a task, a conditional route and a fall-through route."""
    hints = (Hint("hit_timestamp", "string2date", parameters={"format": LOG_DATE}), Hint("user_id", "string2int", parameters={"default": "0"}))
    out = Hint("hit_timestamp", "date2string", parameters={"format": "yyyy.MM.dd HH:mm:ss (ZZZZZ)"})
    node = Node("typed", {"id": "java.lang.String", "hit_timestamp": "java.util.Date", "request": "java.lang.String", "user_id": "java.lang.Integer"}, {"kind": "java.lang.String"}, (Task("first_word", ("request",), (("value", "kind"),)),))
    mapping = (MapExpression("* - request = received:, kind = created:kind"),)
    p = ProcessDef(
        "log_pipeline", (Terminal("logfile", LOG, hints),), (Terminal("fact", None, (out,)), Terminal("rest", None, (out,))),
        (Route("logfile", "typed"), Route("typed", "fact", mapping, And((Is("meta:ok"), Not(Holds("equals", "kind", {"comparisonValue": "error"}))))), Route("@all - (fact + rest + logfile)", "rest", mapping, Not(Is("routing:record-has-been-delivered")))), (node,),
    )
    return united(plan(p, {"logfile": log_lines(table(spark, sf, "events"))}))


def events_net(routes: tuple, out: tuple, compat=None, **more):
    return ProcessDef("events", (source("ev", "event_id", "event_type", "value"),), sinks(*out), routes, **more)


@query("""
SELECT 'r0' AS sink, event_id::VARCHAR AS event_id, event_type FROM events WHERE event_type = 'error'
UNION ALL SELECT 'r1', event_id::VARCHAR, event_type FROM events WHERE event_type IN ('error', 'click')
UNION ALL SELECT 'rest', event_id::VARCHAR, event_type FROM events WHERE event_type NOT IN ('error', 'click')""")
def route_fallthrough(spark, sf):
    keep = (MapField("event_id", "event_id"), MapField("event_type", "event_type"))
    kind = lambda x: Holds("equals", "event_type", {"comparisonValue": x})
    p = events_net((Route("ev", "r0", keep, kind("error")), Route("ev", "r1", keep, Or((kind("error"), kind("click")))), Route("ev", "rest", keep, Not(Is("routing:record-has-been-delivered")))), ("r0", "r1", "rest"))
    return united(plan(p, {"ev": table(spark, sf, "events")}))


@query("SELECT 'all' AS sink, event_id::VARCHAR AS event_id FROM events")
def route_default_condition(spark, sf):
    return united(plan(events_net((Route("ev", "all", (MapField("event_id", "event_id"),)),), ("all",)), {"ev": table(spark, sf, "events")}))


@query("""
SELECT 'out' AS sink, l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber FROM lineitem
WHERE ((l_returnflag = 'R') <> (l_linestatus = 'O')) <> (l_linenumber = 1)
  AND (l_returnflag = 'N' OR l_linenumber > 2) AND NOT l_linenumber = 5""")
def cond_and_or_xor_not(spark, sf):
    eq = lambda f, x: Holds("equals", f, {"comparisonValue": x})
    above = Holds("numeric", "l_linenumber", {"comparisonValue": "2", "comparisonResult": "1"})
    c = And((Xor((eq("l_returnflag", "R"), eq("l_linestatus", "O"), eq("l_linenumber", "1"))), Or((eq("l_returnflag", "N"), above)), Not(eq("l_linenumber", "5")), Const()))
    p = ProcessDef("c", (source("li", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"),), sinks("out"), (Route("li", "out", (MapExpression("l_orderkey = received:, l_linenumber = received:"),), c),))
    return united(plan(p, {"li": table(spark, sf, "lineitem")}))


@query("""
SELECT 'out' AS sink, o_orderkey::VARCHAR AS o_orderkey, n FROM orders CROSS JOIN (VALUES ('n1'), ('n3')) t(n)""")
def nodeset_routes(spark, sf):
    """@nodes - n2 becomes a route from every other node."""
    nodes = tuple(Node(f"n{i}", {"o_orderkey": "String"}) for i in (1, 2, 3))
    fan = tuple(Route("o", n.name) for n in nodes)
    p = ProcessDef("n", (source("o", "o_orderkey"),), sinks("out"), (*fan, Route("@nodes - n2", "out", (MapExpression("o_orderkey = received:"), MapField("nodedata:name", "n")))), nodes)
    return united(plan(p, {"o": table(spark, sf, "orders")}))


@query("""
SELECT 'all' AS sink, c_name AS name, c_nationkey::VARCHAR AS nation FROM customer
UNION ALL SELECT 'all', s_name, s_nationkey::VARCHAR FROM supplier""")
def fan_in_union(spark, sf):
    p = ProcessDef("f", (source("c", "c_name", "c_nationkey"), source("s", "s_name", "s_nationkey")), sinks("all"), (Route("c", "all", (MapField("c_name", "name"), MapField("c_nationkey", "nation"))), Route("s", "all", (MapField("s_name", "name"), MapField("s_nationkey", "nation")))))
    return united(plan(p, {"c": table(spark, sf, "customer"), "s": table(spark, sf, "supplier")}))


@query("SELECT 'out' AS sink, s_name AS name FROM supplier WHERE s_nationkey > 10")
def async_pipe(spark, sf):
    above = Holds("numeric", "s_nationkey", {"comparisonValue": "10", "comparisonResult": "1"})
    p = ProcessDef("p", (source("s", "s_name", "s_nationkey"),), sinks("out"), (Route("s", "queue", (), above), Route("queue", "out", (MapField("s_name", "name"),))), pipes=(Pipe("queue"),))
    return united(plan(p, {"s": table(spark, sf, "supplier")}))


# --- mapping ---------------------------------------------------------------------------


def part_map(spark, sf, *mappings, created=()):
    node = Node("n", {"p_partkey": "Integer", "p_name": "String", "p_size": "Integer"}, {"p_brand": "String"}, (Task("upper", ("p_name",), (("value", "p_brand"),)),))
    ints = tuple(Hint(f, "string2int", parameters={"default": "0"}) for f in ("p_partkey", "p_size"))
    p = ProcessDef("m", (source("part", "p_partkey", "p_name", "p_size", "p_type", hints=ints),), sinks("out"), (Route("part", "n"), Route("n", "out", mappings)), (node,))
    return united(plan(p, {"part": table(spark, sf, "part")}))


@query("SELECT 'out' AS sink, p_partkey::VARCHAR AS key, upper(p_name) AS brand FROM part")
def map_field_rename(spark, sf):
    return part_map(spark, sf, MapField("received:p_partkey", "key"), MapField("created:p_brand", "brand"))


@query("SELECT 'out' AS sink, p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size, upper(p_name) AS p_brand FROM part")
def map_wildcard(spark, sf):
    return part_map(spark, sf, MapExpression("* = received:, * = created:"))


@query("SELECT 'out' AS sink, p_name FROM part")
def map_minus(spark, sf):
    return part_map(spark, sf, MapExpression("* - (p_partkey + p_size) = received:"))


@query("SELECT 'out' AS sink, p_partkey::VARCHAR AS p_partkey, upper(p_name) AS p_name, p_size::VARCHAR AS p_size FROM part")
def map_override(spark, sf):
    return part_map(spark, sf, MapExpression("* = received:, p_name = created:p_brand"))


@query("SELECT 'out' AS sink, p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size, upper(p_name) AS p_brand FROM part")
def map_implicit(spark, sf):
    """Nothing mapped: fields bind by name and type, created before received."""
    return part_map(spark, sf)


@query("SELECT 'out' AS sink, (p_size * 2 + 1)::VARCHAR AS twice, p_name || '-' || upper(p_name) AS both_names FROM part")
def map_expression_typed(spark, sf):
    return part_map(spark, sf, MapExpression("twice = java.lang.Integer {p_size * 2 + 1}, both_names = {concat(received:p_name, '-', p_brand)}"))


# --- nodes, tasks, errors --------------------------------------------------------------


@query("""
SELECT 'out' AS sink, p_partkey::VARCHAR AS p_partkey, split_part(p_type, ' ', 1) AS head,
  CASE WHEN position(' ' IN p_type) > 0 THEN substring(p_type, position(' ' IN p_type) + 1) ELSE '' END AS tail, upper(p_name) AS loud
FROM part WHERE position(' ' IN p_type) > 0 OR true""")
def node_tasks_multi(spark, sf):
    node = Node("n", {"p_partkey": "String", "p_name": "String", "p_type": "String"}, {"head": "String", "tail": "String", "loud": "String"}, (Task("split_pair", ("p_type",), (("head", "head"), ("tail", "tail")), {"separator": " "}), Task("upper", ("p_name",), (("value", "loud"),))))
    p = ProcessDef("t", (source("part", "p_partkey", "p_name", "p_type"),), sinks("out"), (Route("part", "n"), Route("n", "out", (MapExpression("p_partkey = received:, * = created:"),), Const())), (node,))
    got = united(plan(p, {"part": table(spark, sf, "part")}))
    return got.withColumn("tail", F.coalesce("tail", F.lit("")))


def half_net(spark, sf, *routes):
    node = Node("n", {"o_orderkey": "Integer"}, {"half": "Integer"}, (Task("strict_half", ("o_orderkey",), (("half", "half"),)),))
    hint = (Hint("o_orderkey", "string2int", parameters={"default": "0"}),)
    p = ProcessDef("h", (source("o", "o_orderkey", hints=hint),), sinks(*dict.fromkeys(r.destination for r in routes)), (Route("o", "n"), *routes), (node,))
    return united(plan(p, {"o": table(spark, sf, "orders")}))


@query("""
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'fine' END AS sink, o_orderkey::VARCHAR AS o_orderkey, (o_orderkey // 2)::VARCHAR AS half
FROM orders WHERE o_orderkey % 2 = 0""")
def task_failed_event(spark, sf):
    """A task that reports failure still sets its outputs; the record loses meta:ok."""
    keep = (MapExpression("o_orderkey = received:, half = created:half"),)
    return half_net(spark, sf, Route("n", "fine", keep), Route("n", "failed", keep, Is("error:task-failed")))


@query("""
SELECT 'errors' AS sink, 'Exception ValueError Message: odd: ' || o_orderkey AS ex, '|' || o_orderkey AS received, '|' AS created, '|n|node' AS nodedata
FROM orders WHERE o_orderkey % 2 = 1""")
def task_exception_event(spark, sf):
    """The error record as text; the stack trace is cut off for comparison."""
    got = half_net(spark, sf, Route("n", "errors", (MapExpression("* - events = error:"),), Is("error:task-exception")))
    return got.withColumn("ex", F.regexp_extract("ex", r"\A(.*?) Stack trace", 1))


@query("""
SELECT 'rest' AS sink, o_orderkey::VARCHAR AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 10 = 0""")
def error_fallthrough(spark, sf):
    """Routes without a condition leave records with errors to the catch-all."""
    keep = (MapExpression("o_orderkey = received:"),)
    got = half_net(spark, sf, Route("n", "fine", keep), Route("n", "rest", keep, And((Not(Is("meta:ok")), Not(Is("routing:record-has-been-delivered"))))))
    return got.filter("sink = 'rest'")


# --- conversions -----------------------------------------------------------------------


@query("""
SELECT 'out' AS sink, event_id::VARCHAR AS event_id, coalesce(try_cast(regexp_extract(props, '[0-9]+') AS INTEGER), -1)::VARCHAR AS k FROM events""")
def conv_string2int_default(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    p = ProcessDef("i", (source("ev", "event_id", "k", hints=(Hint("k", "string2int", parameters={"default": "-1"}),)),), sinks("out"), (Route("ev", "n"), Route("n", "out")), (Node("n", {"event_id": "String", "k": "Integer"}),))
    return united(plan(p, {"ev": ev}))


@query("""
SELECT CASE WHEN source = 'src7' THEN 'fine' ELSE 'bad' END AS sink, CASE WHEN source = 'src7' THEN lang END AS lang FROM documents""")
def conv_failed_blank_record(spark, sf):
    """One bad field blanks the whole created record: where n is no number, lang is gone as well."""
    docs = table(spark, sf, "documents").select(F.when(F.col("source") == "src7", "7").otherwise(F.concat(F.lit(" "), F.col("source"))).alias("n"), "lang")
    keep = (MapField("created:lang", "lang"),)
    p = ProcessDef("b", (source("d", "n", "lang", hints=(Hint("n", "string2int"),)),), sinks("fine", "bad"), (Route("d", "typed", (MapField("n", "n"), MapField("lang", "lang"))), Route("d", "bad", keep, Is("error:conversion-failed")), Route("typed", "fine", (MapField("lang", "lang"),))), (Node("typed", {"n": "Integer", "lang": "String"}),))
    return united(plan(p, {"d": docs}))


@query("SELECT 'lost' AS sink, lang FROM documents WHERE source <> 'src7'")
def terminal_error_route(spark, sf):
    docs = table(spark, sf, "documents").select(F.when(F.col("source") == "src7", "7").otherwise(F.lit("x")).alias("n"), "lang")
    t = Terminal("d", StreamFormat(("n", "lang")), (Hint("n", "string2int"),), (ErrorRoute("lost", (MapExpression("* - n = received:"),)),))
    p = ProcessDef("e", (t,), sinks("fine"), (Route("d", "typed"), Route("typed", "fine")), (Node("typed", {"n": "Integer", "lang": "String"}),))
    got = plan(p, {"d": docs})
    return got.sinks["lost"].select(F.lit("lost").alias("sink"), "lang")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS text, o_orderdate = date_trunc('second', o_orderdate) AS same FROM orders")
def conv_date_roundtrip(spark, sf):
    fmt = {"format": "dd/MM/yyyy HH:mm:ss"}
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    text = date2string(F.col("d"), fmt)[0]
    return df.select("o_orderkey", text.alias("text"), (string2date(text, fmt)[0] == F.col("d")).alias("same"))


# --- formats ---------------------------------------------------------------------------


@query("""
SELECT event_id::VARCHAR AS id, strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS hit_timestamp, event_type || ' ' || props AS request, user_id::VARCHAR AS user_id FROM events""")
def tokenize_log_line(spark, sf):
    parts = split_line(F.col("line"), LOG)
    return log_lines(table(spark, sf, "events")).select(parts.alias("p")).select(*(F.col("p")[i].alias(f) for i, f in enumerate(LOG.fields)))


@query("""
SELECT event_id::VARCHAR AS id, event_type AS kind, props FROM events""")
def tokenize_multichar(spark, sf):
    """Delimiters of several characters go through the general tokenizer."""
    f = StreamFormat(("id", "kind", "props"), separator="::", quotes=(("<<", ">>"),))
    line = F.concat(F.col("event_id").cast("string"), F.lit("::<<"), "event_type", F.lit(">>::<<"), "props", F.lit(">>"))
    return table(spark, sf, "events").select(split_line(line, f).alias("p")).select(*(F.col("p")[i].alias(x) for i, x in enumerate(f.fields)))


@query("""
SELECT 'Parse Error' AS reason, event_id::VARCHAR || ',' || event_type || ',x' AS line FROM events WHERE event_type = 'click'""")
def discard_unparseable(spark, sf):
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.when(F.col("event_type") == "click", F.lit("x")))
    p = ProcessDef("d", (Terminal("f", StreamFormat(("id", "kind"), separator=",")),), sinks("out"), (Route("f", "out"),))
    return plan(p, {"f": table(spark, sf, "events").select(line.alias("line"))}).discarded["f"]


@query("SELECT c_custkey || '|' || coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, '') || '|' || c_mktsegment AS value FROM customer")
def export_line(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), "c_mktsegment")
    return lines_of(df)


@query("SELECT '|' || n_nationkey || '|' || n_name || '|' || n_regionkey AS record FROM nation")
def record_to_string(spark, sf):
    df = table(spark, sf, "nation").select(F.struct("n_nationkey", "n_name", "n_regionkey").alias("r"))
    return df.select(records.record_to_string(F.col("r"), df.schema["r"].dataType).alias("record"))


@query("""
SELECT 'brand:' || p_brand || '|name:' || p_name || '|ProcessedDataInternalState:OK' AS text, p_brand AS brand, p_name AS name, 'OK' AS state FROM part""")
def record_serialize(spark, sf):
    df = table(spark, sf, "part").select(records.serialize(F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand"), F.lit("OK")).alias("text"))
    back = df.withColumn("r", records.unserialize(F.col("text")))
    return back.select("text", F.col("r.fields")["brand"].alias("brand"), F.col("r.fields")["name"].alias("name"), "r.state")


# --- predicates ------------------------------------------------------------------------


@query("SELECT p_partkey, p_size < 10 AS below, p_size = 10 AS same, p_size > 10 AS above, false AS not_a_number FROM part")
def numeric_cmp(spark, sf):
    cmp = lambda r: PREDICATES["numeric"](F.col("p_size"), {"comparisonValue": "10", "comparisonResult": r})
    return table(spark, sf, "part").select("p_partkey", cmp("-1").alias("below"), cmp("0").alias("same"), cmp("1").alias("above"), PREDICATES["numeric"](F.col("p_name"), {"comparisonValue": "10", "comparisonResult": "0"}).alias("not_a_number"))


@query("""
SELECT c_custkey, contains(c_name, '00') AS has, starts_with(c_mktsegment, 'B') AS starts, ends_with(c_name, '7') AS ends,
  c_mktsegment = 'BUILDING' AS same, regexp_full_match(c_name, '[A-Z].*[0-9]{3}') AS matches, true AS always FROM customer""")
def string_cmp(spark, sf):
    on = lambda kind, f, x: PREDICATES[kind](F.col(f), {"comparisonValue": x})
    return table(spark, sf, "customer").select(
        "c_custkey", on("contains", "c_name", "00").alias("has"), on("startsWith", "c_mktsegment", "B").alias("starts"), on("endsWith", "c_name", "7").alias("ends"),
        on("equals", "c_mktsegment", "BUILDING").alias("same"), on("regexMatches", "c_name", "[A-Z].*[0-9]{3}").alias("matches"), on("true", "c_name", "").alias("always"),
    )


# --- dictionaries, lookups, enrichment -------------------------------------------------


@query("""
SELECT row_number() OVER (ORDER BY f, key) - 1 AS id, key FROM (SELECT user_id::VARCHAR AS key, min(event_id) AS f FROM events GROUP BY 1)""")
def numbered_keyset(spark, sf):
    return keyset.keyset(table(spark, sf, "events").withColumn("k", F.col("user_id").cast("string")), "k", "event_id")


@query("""
WITH f AS (SELECT user_id::VARCHAR AS key, min(event_id) FILTER (event_id % 2 = 0) AS a, min(event_id) AS b FROM events GROUP BY 1),
k AS (SELECT key, row_number() OVER (ORDER BY a, key) - 1 AS id FROM f WHERE a IS NOT NULL)
SELECT id, key FROM k
UNION ALL SELECT (SELECT count(*) FROM k) + row_number() OVER (ORDER BY b, key) - 1, key FROM f WHERE a IS NULL""")
def keyset_incremental(spark, sf):
    ev = table(spark, sf, "events").withColumn("k", F.col("user_id").cast("string"))
    first = keyset.keyset(ev.filter("event_id % 2 = 0"), "k", "event_id")
    return keyset.extend(first, ev, "k", "event_id")


@query("""
WITH k AS (SELECT event_type AS key, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS id FROM events GROUP BY 1)
SELECT event_id, id AS event_type_id, key AS looked_up FROM events JOIN k ON event_type = key""")
def fact_and_lookup(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    fact, lookup = enrich.star(ev, "event_type", "event_id", keyset.keyset(ev, "event_type", "event_id"))
    return fact.join(lookup, fact.event_type_id == lookup.id).select("event_id", "event_type_id", F.col("event_type").alias("looked_up"))


def segments(spark, sf):
    """A stand-in for a slow processor: customers' market segments by key."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ck"), "c_mktsegment")

    def compute(keys):
        got = keys.join(cust, F.col("key") == F.col("ck"), "left")
        return got.select("key", F.create_map(F.lit("segment"), "c_mktsegment").alias("fields"), F.when(F.col("c_mktsegment").isNotNull(), "OK").otherwise("FAILURE").alias("state"))

    return compute


@query("""
SELECT o_orderkey, c_mktsegment AS segment, CASE WHEN c_mktsegment IS NULL THEN 'FAILURE' ELSE 'OK' END AS state
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def cached_enrichment(spark, sf):
    got, _ = enrich.enrich(table(spark, sf, "orders"), "o_custkey", segments(spark, sf))
    return got.select("o_orderkey", F.col("fields")["segment"].alias("segment"), "state")


@query("""
WITH last AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1)
SELECT event_id, CASE WHEN t > TIMESTAMP '2024-01-30' - INTERVAL 3 DAY THEN 'cached' ELSE 'fresh' END AS origin
FROM events JOIN last USING (user_id)""")
def cache_ttl(spark, sf):
    """Entries older than three days are computed anew; the rest come from the cache."""
    ev = table(spark, sf, "events")
    made = lambda df, word: df.select("key", F.create_map(F.lit("origin"), F.lit(word)).alias("fields"), F.lit("OK").alias("state"))
    cache = made(ev.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("ts").alias("timestamp")).select("key"), "cached")
    cache = cache.join(ev.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("ts").cast("timestamp").alias("timestamp")), "key")
    got, _ = enrich.enrich(ev, "user_id", lambda keys: made(keys, "fresh"), cache, days=3, now=F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return got.select("event_id", F.col("fields")["origin"].alias("origin"))


@query("SELECT event_id::VARCHAR AS key FROM events WHERE event_type NOT IN ('click', 'view', 'error')")
def cache_cleaning(spark, sf):
    """Entries that are empty, without fields or in progress are dropped on opening."""
    kind = lambda x: F.col("event_type") == x
    fields = F.when(kind("view"), F.lit(None)).when(kind("error"), F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.lit("x"), "event_type"))
    cache = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("key"), fields.alias("fields"), F.when(kind("click"), "EMPTY").otherwise("OK").alias("state"), F.col("ts").cast("timestamp").alias("timestamp"))
    return enrich.cleaned(cache).select("key")


@query("""
SELECT event_id, user_id::VARCHAR AS ip, CASE WHEN user_id % 5 > 0 THEN 'host' || user_id || CASE WHEN user_id % 2 = 0 THEN '.old' ELSE '.new' END END AS hostname,
  CASE WHEN user_id % 5 > 0 THEN 'OK' ELSE 'FAILURE' END AS state FROM events""")
def host_name_engine(spark, sf):
    """Host names of the last three days come from the cache, the others are resolved once for each address."""
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("ip"), "user_id")
    names = ev.filter("user_id % 5 > 0").select("ip", F.concat(F.lit("host"), "ip", F.lit(".new.")).alias("hostname")).distinct()
    days = F.when(F.col("user_id") % 2 == 0, 1).otherwise(4)
    cache = ev.filter("user_id % 5 > 0").select(F.col("ip").alias("key"), "user_id").distinct()
    cache = cache.select("key", F.create_map(F.lit("hostname"), F.concat(F.lit("host"), "key", F.lit(".old"))).alias("fields"), F.lit("OK").alias("state"), (F.lit("2024-01-30").cast("timestamp") - F.make_interval(days=days)).alias("timestamp"))
    got, _ = netaddr.host_engine(ev.drop("user_id"), "ip", netaddr.named(names), cache, now=F.lit("2024-01-30").cast("timestamp"))
    return got.select("event_id", "ip", "hostname", "state")


def scratch(spark: SparkSession) -> str:
    """A folder for what a query keeps: below the shared one, if the session names it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/{os.urandom(8).hex()}" if shared else tempfile.mkdtemp(prefix="millrace-")


@query("""
WITH f AS (SELECT event_type AS key, min(event_id) FILTER (event_id % 4 = 0) AS a, min(event_id) AS b FROM events GROUP BY 1),
k AS (SELECT key, row_number() OVER (ORDER BY a, key) - 1 AS id FROM f WHERE a IS NOT NULL)
SELECT id, key, 2::BIGINT AS versions FROM k
UNION ALL SELECT (SELECT count(*) FROM k) + row_number() OVER (ORDER BY b, key) - 1, key, 2 FROM f WHERE a IS NULL""")
def keyset_store(spark, sf):
    """A keyset that outlives a run: the second run numbers on from what the first has stored."""
    ev, store = table(spark, sf, "events"), Store(spark, scratch(spark))
    store.keyset("types", ev.filter("event_id % 4 = 0"), "event_type", "event_id")
    got = store.keyset("types", ev, "event_type", "event_id")
    return got.withColumn("versions", F.lit(len(store.versions("types"))).cast("long"))


@query("""
SELECT o_orderkey, c_mktsegment AS segment, CASE WHEN o_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS run
FROM orders JOIN customer ON o_custkey = c_custkey""")
def lookup_store(spark, sf):
    """A lookup table that outlives a run: only keys that it lacks are computed again."""
    store, orders = Store(spark, scratch(spark)), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    compute = segments(spark, sf)
    told = lambda run: lambda keys: compute(keys).select("key", F.map_concat("fields", F.create_map(F.lit("run"), F.lit(run))).alias("fields"), "state")
    store.enrich("segments", orders.filter("o_custkey % 2 = 0"), "o_custkey", told("first"))
    got = store.enrich("segments", orders, "o_custkey", told("second"))
    return got.filter("state = 'OK'").select("o_orderkey", F.col("fields")["segment"].alias("segment"), F.col("fields")["run"].alias("run"))


@query("SELECT row_number() OVER (ORDER BY min(c_name), c_nationkey) - 1 AS id, c_nationkey::VARCHAR AS key FROM customer GROUP BY c_nationkey")
def keyset_text_order(spark, sf):
    """First sight by a text column, in ranges like any other."""
    return keyset.keyset(table(spark, sf, "customer").withColumn("k", F.col("c_nationkey").cast("string")), "k", "c_name")


# --- URLs, requests, addresses, agents -------------------------------------------------

_URL_SQL = """
WITH a AS (SELECT page_id, url, split_part(url, '://', 1) AS schema, substring(url, position('://' IN url) + 3) AS rest FROM pages),
b AS (SELECT *, split_part(rest, '/', 1) AS auth, CASE WHEN position('/' IN rest) > 0 THEN substring(rest, position('/' IN rest) + 1) ELSE '' END AS tail FROM a),
c AS (SELECT *, split_part(auth, ':', 1) AS host,
  CASE WHEN position(':' IN auth) > 0 AND split_part(auth, ':', 2) <> '0' THEN split_part(auth, ':', 2) ELSE '80' END AS port,
  CASE WHEN position('?' IN tail) > 0 THEN substring(tail, 1, position('?' IN tail) - 1) ELSE tail END AS rawpath,
  CASE WHEN position('?' IN tail) > 0 THEN substring(tail, position('?' IN tail) + 1) ELSE '' END AS query FROM b),
d AS (SELECT *, list_filter(string_split(rawpath, '/'), lambda x: x <> '') AS segs,
  CASE WHEN position('#' IN query) > 0 THEN substring(query, 1, position('#' IN query) - 1) ELSE query END AS params,
  CASE WHEN position('#' IN query) > 0 THEN substring(query, position('#' IN query) + 1) ELSE '' END AS fragment FROM c),
e AS (SELECT *, list_transform(list_filter(string_split(params, '&'), lambda x: x <> ''), lambda x: string_split(regexp_replace(x, '=+$', ''), '=')) AS kv FROM d)
"""


@query(_URL_SQL + """
SELECT page_id, schema, host, port, array_to_string(segs, '/') AS path, 'false' AS isdir,
  array_to_string(list_transform(kv, lambda p: p[1] || CASE WHEN len(p) = 2 THEN '=' || p[2] ELSE '' END), '&') AS parameters, fragment FROM e""")
def url_components(spark, sf):
    got = table(spark, sf, "pages").select("page_id", url.fields(url.components(F.col("url"))).alias("u"))
    return got.select("page_id", "u.*").drop("fullurl")


@query(_URL_SQL + """,
n AS (SELECT *, segs[len(segs)] IN ('index.html', 'index.htm', 'index.php', 'default.asp') AS idx FROM e),
m AS (SELECT *, CASE WHEN coalesce(idx, false) THEN segs[:len(segs) - 1] ELSE segs END AS kept FROM n)
SELECT page_id, regexp_replace(lower(host), '^www\\.', '') AS host, array_to_string(kept, '/') AS path, (coalesce(idx, false) OR len(kept) = 0)::VARCHAR AS isdir FROM m""")
def url_normalized(spark, sf):
    got = table(spark, sf, "pages").select("page_id", url.fields(url.normalise(url.components(F.col("url")))).alias("u"))
    return got.select("page_id", "u.host", "u.path", "u.isdir")


@query(_URL_SQL + """,
p AS (SELECT *, array_to_string(list_transform(kv, lambda p: p[1] || CASE WHEN len(p) = 2 THEN '=' || p[2] ELSE '' END), '&') AS ps FROM e)
SELECT page_id, schema || '://' || host || CASE WHEN port <> '80' THEN ':' || port ELSE '' END || CASE WHEN len(segs) > 0 THEN '/' ELSE '' END
  || array_to_string(segs, '/') || CASE WHEN ps <> '' OR fragment <> '' THEN '?' ELSE '' END || ps || CASE WHEN fragment <> '' THEN '#' ELSE '' END || fragment AS fullurl FROM p""")
def url_fullurl(spark, sf):
    return table(spark, sf, "pages").select("page_id", url.full(url.components(F.col("url"))).alias("fullurl"))


@query("SELECT page_id, 'OK' AS state FROM pages UNION ALL SELECT -1 - page_id, 'FAILURE' FROM pages")
def plain_url_state(spark, sf):
    pages = table(spark, sf, "pages")
    both = pages.select("page_id", "url").union(pages.select(-1 - F.col("page_id"), F.regexp_replace("url", "://", ":")))
    return both.select("page_id", url.plain_url(F.col("url"))["state"].alias("state"))


@query("""
SELECT page_id, 'OK' AS state, 'GET' AS httprequest, '/p/' || page_id AS document, 'HTTP/1.1' AS protocol, 'host' || page_id || '.example' AS host, 'p/' || page_id AS path FROM pages""")
def http_request(spark, sf):
    req = F.concat(F.lit("host"), F.col("page_id").cast("string"), F.lit(".example,GET /p/"), F.col("page_id").cast("string"), F.lit(" HTTP/1.1"))
    got = table(spark, sf, "pages").select("page_id", url.http_request(req).alias("r"))
    return got.select("page_id", "r.state", "r.httprequest", "r.document", "r.protocol", "r.url.host", "r.url.path")


@query("""
WITH r AS (SELECT i, i * 70000 AS lo, i * 70000 + 49999 AS hi FROM range(200) t(i)),
a AS (SELECT event_id, (event_id * 7919) % 14000000 AS n FROM events)
SELECT event_id, CASE WHEN i IS NOT NULL THEN 'AS' || i END AS asnCode, CASE WHEN i % 7 > 0 THEN 'C' || i % 9 END AS countryCode, CASE WHEN i % 7 > 0 THEN 'Country ' || i % 9 END AS countryName,
  CASE WHEN i IS NOT NULL THEN 'R' || i % 5 END AS region, CASE WHEN i IS NOT NULL THEN 'City ' || i END AS city, CASE WHEN i IS NOT NULL THEN (1000 + i)::VARCHAR END AS postalCode,
  NULL::VARCHAR AS areaCode, CASE WHEN i % 7 > 0 THEN 'OK' ELSE 'FAILURE' END AS state
FROM a LEFT JOIN r ON n BETWEEN lo AND hi""")
def geo_fields(spark, sf):
    """All seven fields, over ranges that cross the blocks of the join."""
    n = (F.col("event_id") * 7919) % 14000000
    octet = lambda shift: (F.shiftright(n, shift) % 256).cast("string")
    i = F.col("id")
    ranges = spark.range(200).select(
        (i * 70000).alias("lo"), (i * 70000 + 49999).alias("hi"), F.concat(F.lit("AS"), i).alias("asnCode"), F.when(i % 7 > 0, F.concat(F.lit("C"), i % 9)).alias("countryCode"),
        F.when(i % 7 > 0, F.concat(F.lit("Country "), i % 9)).alias("countryName"), F.concat(F.lit("R"), i % 5).alias("region"), F.concat(F.lit("City "), i).alias("city"), (i + 1000).alias("postalCode"),
    )
    ev = table(spark, sf, "events").select("event_id", F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)).alias("ip"))
    return netaddr.geo_lookup(ev, "ip", ranges).drop("ip")


_RANGES = [(i * 40, i * 40 + 29, f"C{i}") for i in range(8)]


@query("""
WITH r AS (SELECT i * 40 AS lo, i * 40 + 29 AS hi, 'C' || i AS countryCode FROM range(8) t(i)),
a AS (SELECT event_id, (user_id // 256) * 256 + user_id % 256 AS n FROM events)
SELECT event_id, countryCode, CASE WHEN lo IS NULL THEN 'FAILURE' ELSE 'OK' END AS state FROM a LEFT JOIN r ON n BETWEEN lo AND hi""")
def ip_range_lookup(spark, sf):
    ip = F.concat_ws(".", F.lit("0"), F.lit("0"), F.floor(F.col("user_id") / 256).cast("string"), (F.col("user_id") % 256).cast("string"))
    ranges = spark.createDataFrame(_RANGES, "lo long, hi long, countryCode string")
    got = netaddr.range_lookup(table(spark, sf, "events").select("event_id", ip.alias("ip")), "ip", ranges)
    return got.select("event_id", "countryCode", "state")


@query("""
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'h' || user_id || '.example' END AS hostname, CASE WHEN user_id % 3 = 0 THEN 'OK' ELSE 'FAILURE' END AS state FROM events""")
def rdns_lookup(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"), "user_id")
    names = ev.filter("user_id % 3 = 0").select("ip", F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.")).alias("hostname")).distinct()
    return netaddr.host_names(ev, "ip", names).select("event_id", "hostname", "state")


AGENTS = [
    ("Opera/9.80 (X11; Linux i686; U; en) Presto/2.2.15 Version/10.10", "Opera", None, "UNIX", "I686"),
    ("Mozilla/4.0 (compatible; MSIE 7.0; Windows NT 5.1)", "MSIE", "XP", "WINDOWS", "UNKNOWN"),
    ("Mozilla/5.0 (Windows; U; Windows NT 6.0; en-US; rv:1.9.1.5) Gecko/20091102 Firefox/3.5.5", "Firefox", "Vista", "WINDOWS", "UNKNOWN"),
    ("Mozilla/4.08 [en] (WinNT; I ;Nav)", "Netscape", "NT", "WINDOWS", "UNKNOWN"),
    ("Java1.4.2_03", "Java", None, "UNKNOWN", "UNKNOWN"),
    ("W3C_Validator/1.654", "W3C_Validator", None, "UNKNOWN", "UNKNOWN"),
]
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in AGENTS)


@query(f"""
SELECT event_id, agentName, agentOSVersion, agentSWPlatform, agentProcessor
FROM events JOIN (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_ROWS}) t(ua, agentName, agentOSVersion, agentSWPlatform, agentProcessor)) ON event_id % 6 = i""")
def user_agent_fields(spark, sf):
    uas = F.array(*(F.lit(a[0]) for a in AGENTS))
    ev = table(spark, sf, "events").select("event_id", F.element_at(uas, (F.col("event_id") % 6 + 1).cast("int")).alias("ua"))
    got = ev.select("event_id", user_agent(F.col("ua")).alias("a"))
    assert set(UA_FIELDS) < set(got.schema["a"].dataType.names)
    return got.select("event_id", "a.agentName", "a.agentOSVersion", "a.agentSWPlatform", "a.agentProcessor")


with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "suite_agents.tsv"), encoding="utf-8") as _f:
    #: Recorded results of the classifier, which guard against change: a string and its thirteen fields.
    ALL_AGENTS = [x.rstrip("\n").split("\t") for x in _f]
_sql = lambda x: "NULL" if x == "" else "'" + x.replace("'", "''") + "'"
_ALL_ROWS = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in ALL_AGENTS)


@query(f"""
SELECT event_id, CASE WHEN "agentName" IS NULL THEN 'FAILURE' ELSE 'OK' END AS state, {", ".join(UA_FIELDS)}
FROM events JOIN (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_ALL_ROWS}) t(ua, {", ".join(UA_FIELDS)})) ON event_id % {len(ALL_AGENTS)} = i""")
def user_agent_all_fields(spark, sf):
    """All thirteen fields of all recorded strings."""
    uas = F.array(*(F.lit(a[0]) for a in ALL_AGENTS))
    ev = table(spark, sf, "events").select("event_id", F.element_at(uas, (F.col("event_id") % len(ALL_AGENTS) + 1).cast("int")).alias("ua"))
    return ev.select("event_id", user_agent(F.col("ua")).alias("a")).select("event_id", "a.*")


# --- strings ---------------------------------------------------------------------------


@query(r"""
SELECT c_custkey, regexp_extract(c_name, '^[A-Za-z]*') AS first_part, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS proper,
  nullif(trim(' ' || c_mktsegment[:c_custkey % 2] || ' '), '') AS nullified, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, '') AS unnullified,
  c_mktsegment || ' ' || c_name AS joined, position('#' IN c_name) - 1 AS pos, CASE WHEN c_acctbal > 0 THEN 'name: ' || c_name ELSE '' END AS label,
  regexp_replace(c_name, '(#|0)', '\\\1', 'g') AS escaped, try_cast(c_custkey::VARCHAR AS INTEGER) IS NOT NULL AS is_int,
  167772160 + c_custkey % 256 AS ip, CASE WHEN c_name LIKE '%1' THEN c_name[:-2] ELSE c_name END AS cut, c_mktsegment AS unsemi,
  '[ ' || c_mktsegment || ' x ]' AS listed, c_mktsegment = 'x' AS member, '<i>' || c_mktsegment || '</i><i>x</i>' AS xml
FROM customer""")
def string_utils(spark, sf):
    name, seg, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    maybe = F.when(F.col("c_acctbal") > 0, name)
    items = F.array(seg, F.lit("x"))
    return table(spark, sf, "customer").select(
        "c_custkey", strings.first_part(name).alias("first_part"), strings.correct_case(seg).alias("proper"),
        strings.nullify(F.concat(F.lit(" "), F.substring(seg, F.lit(1), (key % 2).cast("int")), F.lit(" "))).alias("nullified"),
        strings.unnullify(maybe).alias("unnullified"), strings.smart_concat(seg, name).alias("joined"), strings.find_pos(name, "#").cast("long").alias("pos"),
        strings.maybe_print("name", maybe).alias("label"), strings.escape_sequences(name, ["#", "0"], "\\").alias("escaped"),
        strings.is_integer(key.cast("string")).alias("is_int"),
        strings.string_to_ip(F.concat(F.lit("10.0.0."), (key % 256).cast("string"))).alias("ip"),
        strings.remove_trailing(name, "1").alias("cut"), strings.chain(F.concat(seg, F.lit(";")), strings.remove_trailing_semicolon).alias("unsemi"),
        strings.array_to_string(items).alias("listed"), strings.array_member(F.array(F.lit("x")), seg).alias("member"), strings.xml_items(items, "i").alias("xml"),
    )


@query(r"""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '\|' ELSE c_name END AS slashed, c_name LIKE 'Customer%' AS starts, true AS starts_null, false AS null_starts, c_name LIKE '%9' AS ends, true AS ends_null, false AS null_ends,
  c_mktsegment || ';' || c_name AS items, '#' || regexp_replace(c_name, '(#)', '\\\1', 'g') AS escaped_old, '\#' || regexp_replace(c_name, '(#)', '\\\1', 'g') AS escaped,
  CASE WHEN c_custkey < 256 THEN (16777216 * 10 + c_custkey)::VARCHAR END AS ip, 16777216 * 10 + c_custkey % 256 AS ip_loose
FROM customer""")
def string_edges(spark, sf):
    """Helpers at their edges: a lone bar, null needles, a sequence at the start, octets above 255."""
    name, key = F.col("c_name"), F.col("c_custkey")
    null, sharp = F.lit(None).cast("string"), F.concat(F.lit("#"), name)
    address = F.concat(F.lit("10.0.0."), key.cast("string"))
    return table(spark, sf, "customer").select(
        "c_custkey", strings.addslashes(F.when(key % 3 == 0, "|").otherwise(name)).alias("slashed"),
        strings.starts_with(name, F.lit("Customer")).alias("starts"), strings.starts_with(name, null).alias("starts_null"), strings.starts_with(null, name).alias("null_starts"),
        strings.ends_with(name, F.lit("9")).alias("ends"), strings.ends_with(name, null).alias("ends_null"), strings.ends_with(null, name).alias("null_ends"),
        strings.join_items(F.array("c_mktsegment", "c_name"), ";").alias("items"), strings.escape_sequences(sharp, ["#"], "\\", compat=True).alias("escaped_old"), strings.escape_sequences(sharp, ["#"], "\\").alias("escaped"),
        strings.string_to_ip(address).cast("string").alias("ip"), strings.string_to_ip(address, strict=False).alias("ip_loose"),
    )


# --- readers of odd lines, records with dates, other conversions ---------------------------


@query("""
SELECT event_id::VARCHAR || chr(1) AS id, event_type || chr(1) || ',' || props AS rest FROM events""")
def tokenize_control_char(spark, sf):
    """The character that the native reader cuts with may stand in a line as well."""
    f = StreamFormat(("id", "rest"), separator=",", quotes=(("<", ">"),))
    line = F.concat(F.col("event_id").cast("string"), F.lit("\x01,<"), "event_type", F.lit("\x01,"), "props", F.lit(">"))
    return table(spark, sf, "events").select(split_line(line, f).alias("p")).select(*(F.col("p")[i].alias(x) for i, x in enumerate(f.fields)))


@query("""
SELECT p_partkey, p_name || ' äöü' AS latin, p_name || ' őű' AS central, p_name || ' äő' AS wide FROM part""")
def decode_encodings(spark, sf):
    """Bytes of three encodings: one that Spark knows, one that Python decodes, one of two bytes a character."""

    @F.pandas_udf("binary")
    def in_latin2(s):
        return s.map(lambda x: x.encode("iso-8859-2"))

    text = lambda tail: F.concat("p_name", F.lit(tail))
    return table(spark, sf, "part").select(
        "p_partkey", decoded(F.encode(text(" äöü"), "ISO-8859-1"), "ISO-8859-1").alias("latin"), decoded(in_latin2(text(" őű")), "ISO-8859-2").alias("central"),
        decoded(F.encode(text(" äő"), "UTF-16LE"), "UTF-16LE").alias("wide"),
    )


@query("""
SELECT event_id, 'k:' || event_type || '|ProcessedDataInternalState:OK|timestamp:' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, event_type AS k, 'OK' AS state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, NULL::VARCHAR AS modified FROM events""")
def record_timestamps(spark, sf):
    """Stored entries with the time of processing; a date that is not known is left out."""
    ev = table(spark, sf, "events").select("event_id", records.serialize(F.create_map(F.lit("k"), "event_type"), F.lit("OK"), F.col("ts").cast("timestamp"), F.lit(None).cast("timestamp")).alias("text"))
    r = records.unserialize(F.col("text"))
    return ev.select("event_id", "text", r["fields"]["k"].alias("k"), r["state"].alias("state"), F.date_format(r["timestamp"], records.DATES).alias("at"), F.date_format(r["dataSourceModified"], records.DATES).alias("modified"))


@query("""
SELECT 'out' AS sink, event_id::VARCHAR AS event_id, upper(event_type) AS event_type, value::VARCHAR AS value FROM events""")
def conv_by_method(spark, sf):
    """Hints that name a method: of the value, by a path, and of a class of one's own."""
    ev = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("value").cast("string").alias("value"))
    hints = (Hint("event_id", "com.example.Conversions.string2int"), Hint("event_type", "java.lang.String.toUpperCase"), Hint("value", "millrace.suite.Doubles.read", parameters={"factor": "1"}))
    p = ProcessDef("m", (source("ev", "event_id", "event_type", "value", hints=hints),), sinks("out"), (Route("ev", "n"), Route("n", "out")), (Node("n", {"event_id": "Integer", "event_type": "String", "value": "Double"}),))
    return united(plan(p, {"ev": ev}))


class Doubles:
    """A conversion class: made with its parameters, its methods take the value."""

    def __init__(self, parameters: dict):
        self.factor = float(parameters.get("factor", 1))

    def read(self, v):
        return v.try_cast("double") * self.factor


class Halver:
    """A task class: runTask says whether it worked, getters give the outputs."""

    def __init__(self, parameters: dict):
        self.by, self.half = int(parameters["by"]), None

    def runTask(self, n):
        self.half = n // self.by
        return n % self.by == 0

    def getHalf(self):
        return self.half


python_task("halver", {"half": "int"})(Halver)


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'fine' ELSE 'failed' END AS sink, o_orderkey::VARCHAR AS o_orderkey, (o_orderkey // 3)::VARCHAR AS half FROM orders""")
def task_class(spark, sf):
    """A class as a task: instance call, parameters, getters."""
    keep = (MapExpression("o_orderkey = received:, half = created:half"),)
    node = Node("n", {"o_orderkey": "Integer"}, {"half": "Integer"}, (Task("halver", ("o_orderkey",), (("half", "half"),), {"by": "3"}),))
    p = ProcessDef("h", (source("o", "o_orderkey", hints=(Hint("o_orderkey", "string2int"),)),), sinks("fine", "failed"), (Route("o", "n"), Route("n", "fine", keep), Route("n", "failed", keep, Is("error:task-failed"))), (node,))
    return united(plan(p, {"o": table(spark, sf, "orders")}))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def table_format(spark, sf):
    """Columns of a table in declared JDBC types, as strings."""
    return as_strings(table(spark, sf, "nation").select("n_nationkey", "n_name"), 2, {"n_nationkey": 4, "n_name": 12})


# --- embedded networks -----------------------------------------------------------------


@query("""
SELECT 'out' AS sink, o_orderkey::VARCHAR AS o_orderkey, split_part(o_orderpriority, '-', 1) AS grade,
  CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) END AS closed, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS still
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def embedded_network(spark, sf):
    """A network as a task: an entry, a node, two exits; what comes to no exit is gone. A call before it stays set."""
    inner = Network(
        {"in": (MapField("o_orderstatus", "status"), MapField("o_orderpriority", "name"))},
        {"done": (MapField("loud", "closed"),), "open": (MapField("name", "still"),)},
        (Route("in", "louder"), Route("louder", "done", (MapExpression("loud = created:"),), Holds("equals", "status", {"comparisonValue": "F"})), Route("louder", "open", (MapExpression("name = received:"),), Holds("equals", "status", {"comparisonValue": "O"}))),
        (Node("louder", {"status": "String", "name": "String"}, {"loud": "String"}, (Task("upper", ("name",), (("value", "loud"),)),)),),
    )
    cut = Task("split_pair", ("o_orderpriority",), (("head", "grade"),), {"separator": "-"})
    node = Node("n", {"o_orderkey": "String", "o_orderstatus": "String", "o_orderpriority": "String"}, {"grade": "String", "closed": "String", "still": "String"}, (cut, inner))
    p = ProcessDef("e", (source("o", "o_orderkey", "o_orderstatus", "o_orderpriority"),), sinks("out"), (Route("o", "n"), Route("n", "out", (MapExpression("o_orderkey = received:, * = created:"),))), (node,))
    return united(plan(p, {"o": table(spark, sf, "orders")}))


@query("""
SELECT 'out' AS sink, o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 THEN (o_orderkey // 2)::VARCHAR END AS half,
  CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 2 = 1 THEN 'thrown' END AS fault
FROM orders""")
def embedded_errors(spark, sf):
    """Errors within a network within a network: its routes decide where they go."""
    halves = Network(
        {"number": (MapField("n", "o_orderkey"),)}, {"fine": (MapField("half", "h"),), "bad": (MapField("why", "f"),)},
        (
            Route("number", "halving"), Route("halving", "fine", (MapExpression("half = created:"),)),
            Route("halving", "bad", (MapExpression("why = java.lang.String {'failed'}"),), Is("error:task-failed")), Route("halving", "bad", (MapExpression("why = java.lang.String {'thrown'}"),), Is("error:task-exception")),
        ),
        (Node("halving", {"o_orderkey": "Integer"}, {"half": "Integer"}, (Task("strict_half", ("o_orderkey",), (("half", "half"),)),)),),
    )
    outer = Network(
        {"in": (MapField("o_orderkey", "n"),)}, {"end": (MapField("h", "half"), MapField("f", "fault"))}, (Route("in", "holder"), Route("holder", "p", (MapExpression("* = created:"),)), Route("p", "end")),
        (Node("holder", {"n": "Integer"}, {"h": "Integer", "f": "String"}, (halves,)),), (Pipe("p"),),
    )
    node = Node("n", {"o_orderkey": "Integer"}, {"half": "Integer", "fault": "String"}, (outer,))
    p = ProcessDef("e", (source("o", "o_orderkey", hints=(Hint("o_orderkey", "string2int"),)),), sinks("out"), (Route("o", "n"), Route("n", "out", (MapExpression("o_orderkey = received:, fault = created:, half = java.lang.String {string(half)}"),))), (node,))
    return united(plan(p, {"o": table(spark, sf, "orders")}))


# --- files and streams -----------------------------------------------------------------


@query("SELECT 'out' AS sink, p_partkey::VARCHAR AS key, p_name AS name, upper(p_name) AS brand FROM part")
def file_round_trip(spark, sf):
    """A sink written as a file and read again as an input, with own separator, quotes and escapes."""
    made = part_map(spark, sf, MapExpression("* - (p_size) = received:, p_brand = created:")).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    f, path = StreamFormat(("key", "name", "brand"), separator=" ", quotes=(("'", "'"),)), scratch(spark)
    write_lines(made, path, f, escape=True)
    return united(plan(ProcessDef("again", (Terminal("file", f),), sinks("out"), (Route("file", "out"),)), {"file": read_lines(spark, [path])}))


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'err' ELSE 'rest' END AS sink, event_id::VARCHAR AS event_id, event_type FROM events""")
def stream_network(spark, sf):
    """The network over a stream of files, run until all that is there has been read."""
    f, path = StreamFormat(("event_id", "event_type")), scratch(spark)
    write_lines(table(spark, sf, "events").select("event_id", "event_type"), f"{path}/lines", f)
    routes = (Route("ev", "err", (), Holds("equals", "event_type", {"comparisonValue": "error"})), Route("ev", "rest", (), Not(Is("routing:record-has-been-delivered"))))
    out = ProcessDef("s", (Terminal("ev", f),), (Terminal("err", f), Terminal("rest", f)), routes)
    for q in start(spark, out, {"ev": f"{path}/lines"}, f"{path}/out", f"{path}/state"):
        q.awaitTermination()
    parts = [united(plan(ProcessDef("r", (Terminal("in", f),), sinks(x), (Route("in", x),)), {"in": read_lines(spark, [f"{path}/out/{x}"])})) for x in ("err", "rest")]
    return parts[0].unionByName(parts[1])


@query("SELECT 'out' AS sink, p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def map_plus(spark, sf):
    """A set of named fields."""
    return part_map(spark, sf, MapExpression("p_partkey + p_name = received:"))


# --- counters --------------------------------------------------------------------------


@query("""
SELECT kind, source, destination, count(*) AS n FROM (
  SELECT 'element' AS kind, 'ev' AS source, '' AS destination FROM events
  UNION ALL SELECT 'element', 'err', '' FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'element', 'rest', '' FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'route', 'ev', 'err' FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'route', 'ev', 'rest' FROM events WHERE event_type <> 'error') GROUP BY ALL""")
def monitor_counts(spark, sf):
    keep = (MapField("event_id", "event_id"),)
    p = events_net((Route("ev", "err", keep, Holds("equals", "event_type", {"comparisonValue": "error"})), Route("ev", "rest", keep, Not(Is("routing:record-has-been-delivered")))), ("err", "rest"))
    return counts(plan(p, {"ev": table(spark, sf, "events")}))


@query("""
SELECT kind, source, destination, count(*) AS n FROM (
  SELECT 'element' AS kind, 'ev' AS source, '' AS destination FROM events
  UNION ALL SELECT 'element', 'err', '' FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'element', 'rest', '' FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'route', 'ev', 'err' FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'route', 'ev', 'rest' FROM events WHERE event_type <> 'error') GROUP BY ALL""")
def run_counts(spark, sf):
    """The same counts, left by the run that writes the sinks."""
    keep = (MapField("event_id", "event_id"),)
    p = events_net((Route("ev", "err", keep, Holds("equals", "event_type", {"comparisonValue": "error"})), Route("ev", "rest", keep, Not(Is("routing:record-has-been-delivered")))), ("err", "rest"))
    got = plan(p, {"ev": table(spark, sf, "events")}, observe=True)
    for df in got.sinks.values():
        df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(r["kind"], r["source"], r["destination"], r["n"]) for r in observed(got)], "kind string, source string, destination string, n long")
