"""Parsers, analyzer and planner of networks."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.conditions import And, Const, Holds, Is, Not
from millrace.operators.predicates import predicate
from millrace.operators.tasks import native_task, python_task
from millrace.plans import mapping as m
from millrace.plans.analyzer import analyze
from millrace.plans.model import Compat, DefinitionError, ErrorRoute, Hint, MapExpression, MapField, Network, Node, Pipe, ProcessDef, Route, StreamFormat, Task, Terminal, spark_type
from millrace.plans.nodeset import evaluate
from millrace.plans.planner import plan
from millrace.plans.xmlconfig import load
from millrace.sources.files import read_jdbc

SETS = {"@all": ["s", "a", "b", "a-b", "p", "k"], "@sources": ["s", "p"], "@sinks": ["k"], "@nodes": ["a", "b", "a-b"], "@pipes": ["p"]}


@native_task("t_upper")
def t_upper(params, s):
    return F.upper(s)


def _register():  # a nested function travels to the workers by value
    @python_task("t_boom", {"x": "string"})
    def t_boom(params, s):
        if s == "boom":
            raise RuntimeError("bang")
        return {"x": s + "!", "ok": s != "bad"}

    @python_task("t_half", {"half": "int"})
    def t_half(params, n):
        if n % 2:
            raise ValueError("odd")
        return n // 2


_register()


@pytest.mark.parametrize("text,want", [
    ("@nodes", ["a", "b", "a-b"]), ("@all - (k + s)", ["a", "b", "a-b", "p"]), ("a-b", ["a-b"]), ("a + p", ["a", "p"]), ("@all - s - k", ["a", "b", "a-b", "p"]), ("((a))", ["a"]),
])
def test_node_sets(text, want):
    assert evaluate(text, SETS) == want


def test_node_sets_right_associative_and_errors():
    assert evaluate("@all - s - k", SETS, right_associative=True) == ["a", "b", "a-b", "p", "k"]
    for bad in ("", "a +", "(a", "zz", "a b", "a ! b"):
        with pytest.raises(DefinitionError):
            evaluate(bad, SETS)


def test_mapping_expressions():
    d = m.parse("* = received:, x = created:y, z = java.lang.Integer {a + 1}, w = {b}, * - (a + b) = error:, @all = received:, @(all - a) = created:")
    assert d[0] == m.Definition(True, (), (), m.FromRecord("received"))
    assert d[1] == m.Definition(False, ("x",), (), m.FromField("created", "y"))
    assert d[2].source == m.FromExpression("java.lang.Integer", "a + 1") and d[3].source == m.FromExpression(None, "b")
    assert d[4].every and d[4].minus == ("a", "b") and d[5].every and d[6].minus == ("a",)
    assert m.parse("* + q = received:")[0].plus == ("q",)
    assert m.parse("* + q = received:", Compat(plus_removes_fields=True))[0].minus == ("q",)
    for bad in ("x", "x = nowhere:", "x = a b", "1 = received:"):
        with pytest.raises(DefinitionError):
            m.parse(bad)


def small(*routes, nodes=(), pipes=(), outputs=("out",), hints=(), errors=()):
    return ProcessDef("p", (Terminal("in", StreamFormat(("a", "b")), hints, errors),), tuple(Terminal(o) for o in outputs), routes, nodes, pipes)


@pytest.mark.parametrize("p", [
    small(Route("in", "zz")),
    small(Route("in", "n"), nodes=(Node("n", {"c": "String"}),)),
    small(Route("in", "n"), Route("n", "m"), Route("m", "n"), nodes=(Node("n", {"a": "String"}), Node("m", {"a": "String"}))),
    small(Route("in", "n"), nodes=(Node("n", {"a": "String"}, {"x": "String"}, (Task("t_upper", ("zz",), (("value", "x"),)),)),)),
    small(Route("in", "n"), nodes=(Node("n", {"a": "String"}, {"x": "String"}, (Task("t_upper", ("a",), (("value", "y"),)),)),)),
    small(Route("in", "n"), nodes=(Node("n", {"a": "String"}, {"x": "String"}, (Task("t_upper", ("a",), (("value", "x"),)),) * 2),)),
    small(Route("in", "out", (MapField("zz", "q"),))),
    small(Route("in", "n", (MapExpression("a = int {1}"),)), nodes=(Node("n", {"a": "String"}),)),
    small(Route("in", "in")), small(Route("n", "n"), nodes=(Node("n", {"a": "String"}),)), small(outputs=("in",)),
])
def test_bad_definitions(p):
    with pytest.raises(DefinitionError):
        analyze(p)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def data(spark, *values):
    return spark.createDataFrame(list(values), "a string, b string")


def test_pipe_takes_the_first_routes_fields(spark):
    p = small(Route("in", "q", (MapField("a", "x"),)), Route("q", "out"), pipes=(Pipe("q"),))
    got = plan(p, {"in": data(spark, ("1", "2"))})
    assert got.sinks["out"].columns == ["x"] and rows(got.sinks["out"]) == [("1",)]


def test_task_events_and_error_records(spark):
    node = Node("n", {"a": "String"}, {"x": "String", "y": "String"}, (Task("t_upper", ("a",), (("value", "y"),)), Task("t_boom", ("a",), (("x", "x"),)), ))
    keep = (MapExpression("a = received:, x = created:x, y = created:y"),)
    routes = (Route("in", "n"), Route("n", "out", keep), Route("n", "failed", keep, Is("error:task-failed")), Route("n", "thrown", (MapExpression("* = error:"),), Is("error:task-exception")), Route("n", "rest", keep, Not(Is("routing:record-has-been-delivered"))))
    p = small(*routes, nodes=(node,), outputs=("out", "failed", "thrown", "rest"))
    src = data(spark, ("fine", "1"), ("bad", "2"), ("boom", "3"))
    got = plan(p, {"in": src}, persist=True)
    assert rows(got.sinks["out"]) == [("fine", "fine!", "FINE")] and rows(got.sinks["failed"]) == [("bad", "bad!", "BAD")] and rows(got.sinks["rest"]) == []
    ex, received, created, node_data, events = got.sinks["thrown"].first()
    assert ex.startswith("Exception RuntimeError Message: bang Stack trace: ") and "\n" not in ex
    assert (received, created, node_data, events) == ("|boom", "||BOOM", "|n|node", "[ERROR_TASK_EXCEPTION]")
    old = plan(p, {"in": src}, Compat(keep_ok_on_error=True))
    assert len(rows(old.sinks["out"])) == 3


def test_conversion_failures_and_error_routes(spark):
    node = Node("n", {"a": "Integer", "b": "String"})
    p = small(Route("in", "n"), Route("n", "out"), nodes=(node,), hints=(Hint("a", "string2int"),), errors=(ErrorRoute("lost", (MapExpression("* = received:"),)),))
    got = plan(p, {"in": data(spark, ("1", "x"), (" 2", "y"), (None, "z"), ("99999999999", "w"))})
    assert rows(got.sinks["out"]) == [("1", "x")]
    assert len(rows(got.sinks["lost"].na.fill(""))) == 3


def test_lines_and_discards(spark):
    p = ProcessDef("p", (Terminal("in", StreamFormat(("a", "b"), separator=",")),), (Terminal("out"),), (Route("in", "out"),))
    got = plan(p, {"in": lines(spark, '1,"x,y"', "only", "1,2,3", '\\"q,', '"open,z')})
    assert rows(got.sinks["out"]) == [('"q', ""), ("1", "x,y")]
    assert rows(got.discarded["in"]) == [("Parse Error", '"open,z'), ("Parse Error", "1,2,3"), ("Parse Error", "only")]


def test_conditions_over_fields(spark):
    c = And((Holds("numeric", "a", {"comparisonValue": "2", "comparisonResult": "1"}), Const(), Not(Holds("contains", "b", {"comparisonValue": "z"}))))
    got = plan(small(Route("in", "out", (), c)), {"in": data(spark, ("3", "x"), ("3", "z"), ("1", "x"), (None, "x"), ("x", "x"))})
    assert rows(got.sinks["out"]) == [("3", "x")]


def test_no_shuffle_in_a_network(spark):
    from millrace import suite

    text = suite.route_fallthrough(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "event_type" in text


def shouted(**more):
    """A node that holds a network with one node."""
    inner = Node("up", {"s": "String"}, {"t": "String"}, (Task("t_upper", ("s",), (("value", "t"),)),))
    given = {"inputs": {"in": (MapField("word", "s"),)}, "outputs": {"out": (MapField("t", "loud"),)}, "routes": (Route("in", "up"), Route("up", "out", (MapExpression("t = created:"),))), "nodes": (inner,)} | more
    node = Node("n", {"word": "String"}, {"loud": "String", "size": "Integer"}, (Network(**given),))
    return ProcessDef("p", (Terminal("a", StreamFormat(("word",))),), (Terminal("z"),), (Route("a", "n"), Route("n", "z", (MapExpression("word = received:, loud = created:"),))), (node,))


def test_embedded_network(spark):
    lines = spark.createDataFrame([("ab",), ("",), (None,), ("ab",)], "word string")
    got = plan(shouted(), {"a": lines})
    assert sorted(got.sinks["z"].collect(), key=str) == sorted([("ab", "AB"), ("", ""), (None, None), ("ab", "AB")], key=str)
    assert "Exchange" not in got.sinks["z"]._jdf.queryExecution().toString()
    twice = shouted(inputs={"in": (MapField("word", "s"),), "also": ()}, routes=(Route("in", "up"), Route("up", "out", (MapExpression("t = created:"),)), Route("also", "out", (MapExpression("t = {word}"),))))
    assert sorted(r.loud for r in plan(twice, {"a": lines.limit(1)}).sinks["z"].collect()) == ["AB", "ab"]


@pytest.mark.parametrize(
    "more",
    [
        {"inputs": {"in": (MapField("none", "s"),)}},
        {"inputs": {"in": (MapExpression("s = {word}"),)}},
        {"outputs": {"out": (MapField("none", "loud"),)}},
        {"outputs": {"out": (MapField("t", "none"),)}},
        {"outputs": {"out": (MapField("t", "size"),)}},
        {"outputs": {"out": (MapField("t", "loud"),), "unled": ()}},
        {"routes": (Route("in", "up"), Route("up", "in"))},
    ],
)
def test_bad_embedded_networks(more):
    with pytest.raises(DefinitionError):
        analyze(shouted(**more))


def test_exceptions_pass_an_embedded_network(spark):
    half = Task("t_half", ("k",), (("half", "half"),))
    inner = Network({"in": ()}, {"out": (MapField("k", "same"),)}, (Route("in", "out"),))
    node = Node("n", {"k": "Integer"}, {"half": "Integer", "same": "Integer"}, (half, inner))
    keep = (MapExpression("* = received:, * = created:"),)
    p = ProcessDef("p", (Terminal("a", StreamFormat(("k",)), (Hint("k", "string2int"),)),), (Terminal("y"), Terminal("z")), (Route("a", "n"), Route("n", "z", keep), Route("n", "y", (MapExpression("k = received:, same = java.lang.String {string(same)}"),), Is("error:task-exception"))), (node,))
    got = plan(p, {"a": spark.createDataFrame([("4",), ("3",)], "k string")})
    assert [tuple(r) for r in got.sinks["z"].collect()] == [("4", "2", "4")] and [tuple(r) for r in got.sinks["y"].collect()] == [("3", None)]


EMBEDDED = """
<d><network name="shout"><io><inputRef>in</inputRef><outputRef>out</outputRef></io>
  <node name="up"><receivedFields><column name="s"/></receivedFields><createdFields><column name="t"/></createdFields>
    <tasks><call><class>t_upper</class><input field="s"/><output variable="value" field="t"/></call></tasks></node>
  <route><source>in</source><destination>up</destination></route>
  <route><source>up</source><destination>out</destination><mapExpression expression="t = created:"/></route></network>
<process name="p"><terminals><input name="a"><datasource><format><streamFormat><fields><column name="word"/></fields></streamFormat></format></datasource></input><output name="z"/></terminals>
<network><io><inputRef>a</inputRef><outputRef>z</outputRef></io>
  <node name="n"><receivedFields><column name="word"/></receivedFields><createdFields><column name="loud"/></createdFields>
    <tasks><network><processingNetworkRef>REF</processingNetworkRef>
      <inputRecordMapping recordName="in"><mapField source="word" destination="s"/></inputRecordMapping>
      <outputRecordMapping recordName="out"><mapField source="t" destination="loud"/></outputRecordMapping></network></tasks></node>
  <route><source>a</source><destination>n</destination></route><route><source>n</source><destination>z</destination></route></network></process></d>"""


def test_embedded_network_from_xml(spark):
    p = load(EMBEDDED.replace("REF", "shout"))["p"]
    assert [tuple(r) for r in plan(p, {"a": spark.createDataFrame([("ab",)], "word string")}).sinks["z"].collect()] == [("ab", "AB")]
    with pytest.raises(DefinitionError):
        load(EMBEDDED.replace("REF", "none"))
    with pytest.raises(DefinitionError):
        load(EMBEDDED.replace("REF", "shout").replace('recordName="out"', 'recordName="end"'))
    itself = "<network><processingNetworkRef>shout</processingNetworkRef><inputRecordMapping recordName='in'/><outputRecordMapping recordName='out'/></network>"
    with pytest.raises(DefinitionError):
        load(EMBEDDED.replace("REF", "shout").replace("<tasks><call>", f"<tasks>{itself}<call>"))


def test_jdbc_reader(spark, tmp_path):
    """An embedded database in this process stands for a server."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:millrace;create=true"
    rows = spark.createDataFrame([(i, f"n{i}", None if i == 2 else i / 2) for i in range(6)], "K int, NAME string, X double")
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="t").mode("overwrite").save()
    got = read_jdbc(spark, url, "SELECT k, name, x FROM t WHERE k > 1", 3, types={"k": 4, "name": 12, "x": 8})
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("2", "n2", None), ("3", "n3", "1.5"), ("4", "n4", "2.0"), ("5", "n5", "2.5")]
    assert set(got.dtypes) == {(c, "string") for c in got.columns}
    parts = read_jdbc(spark, url, "SELECT k, name FROM t", 2, partitionColumn="K", lowerBound=0, upperBound=6, numPartitions=3)
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 6
    for columns, types in ((2, None), (3, {"k": 12, "name": 12, "x": 12})):
        with pytest.raises(DefinitionError):
            read_jdbc(spark, url, "SELECT k, name, x FROM t", columns, types=types)


@pytest.mark.parametrize(
    "name,want",
    [
        ("java.lang.Integer", "int"), (" Date ", "timestamp"), ("java.lang.String[]", "array<string>"), ("int[][]", "array<array<int>>"), ("java.util.List<java.lang.Long>", "array<bigint>"),
        ("java.util.Map<String, java.util.List<Double>>", "map<string,array<double>>"), ("List<?>", "array<string>"), ("List<? extends java.lang.Integer>", "array<int>"), ("decimal(9,2)", "decimal(9,2)"), ("struct<a:int>", "struct<a:int>"),
    ],
)
def test_type_names(name, want):
    assert spark_type(name) == want


def test_bad_type_names():
    for name in ("List<int", "List<int,int>", "Map<int>"):
        with pytest.raises(DefinitionError):
            spark_type(name)


def test_predicate_classes(spark):
    seen = []

    @predicate("t_longer")
    class Longer:
        def setParameters(self, params):
            self.least = int(params["least"])

        def init(self):
            return self.least >= 0

        def isEvent(self, value):
            return F.length(value) > self.least

        def close(self):
            seen.append(self.least)

    df = data(spark, ("abc", "x"), ("a", "y"), (None, "z"))
    p = lambda least: small(Route("in", "out", (), Holds("t_longer", "a", {"least": least})))
    assert rows(plan(p("2"), {"in": df}).sinks["out"]) == [("abc", "x")] and seen == [2]
    with pytest.raises(DefinitionError):
        plan(p("-1"), {"in": df})
