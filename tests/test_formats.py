"""Tokenizer, exporter, files, streaming, loader and command line."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import cli, suite  # noqa: F401  the suite registers tasks
from millrace.monitor import Monitor, report
from millrace.plans.model import ColumnFormat, DefinitionError, StreamFormat
from millrace.plans.planner import plan
from millrace.plans.xmlconfig import load
from millrace.sources import files
from millrace.sources.formats import ParseError, column_formats, compiled, export_line, split_line, tokenize, values

XML = """
<processes xmlns="urn:x" xmlns:dp="urn:dp" xmlns:df="urn:df" xmlns:dt="urn:dt">
 <process name="two">
  <terminals>
   <input name="log" monitorFrequency="1"><datasource><df:format><df:streamFormat>
     <df:encoding>utf-8</df:encoding><df:newline>&#xA;</df:newline><df:separator>,</df:separator><df:escape>\\</df:escape>
     <df:fields><df:column name="aa"/><df:column name="bb"/></df:fields>
     <df:columnFormatting>
       <df:column columnRef="aa"><df:quotes><df:start>[</df:start><df:end>]</df:end></df:quotes></df:column>
       <df:column columnRef="bb"><df:quotes><df:quotes>&quot;</df:quotes></df:quotes></df:column>
     </df:columnFormatting></df:streamFormat></df:format></datasource>
     <conversionHint field="aa"><name>string2int</name><parameters default="0"/></conversionHint></input>
   <output name="fact"/><output name="rest"/>
  </terminals>
  <network>
   <dp:io><dp:inputRef>log</dp:inputRef><dp:outputRef>fact</dp:outputRef><dp:outputRef>rest</dp:outputRef><dp:asyncPipe name="q"/></dp:io>
   <dp:node name="n"><dp:receivedFields><df:column name="aa" javaType="java.lang.Integer"/><df:column name="bb" javaType="java.lang.String"/></dp:receivedFields>
     <dp:createdFields><df:column name="cc" javaType="java.lang.String"/></dp:createdFields>
     <dp:tasks><dp:call><dt:method>first_word</dt:method><dt:input field="bb"/><dt:output variable="value" field="cc"/></dp:call></dp:tasks></dp:node>
   <dp:route><dp:source>log</dp:source><dp:destination>n</dp:destination></dp:route>
   <dp:route><dp:source>n</dp:source><dp:destination>q</dp:destination><dp:mapExpression expression="* = received:, * = created:"/>
     <dp:condition><dt:not><dt:predicate><dt:objectInstance><dt:class>x.numeric</dt:class><dt:parameters comparisonValue="0" comparisonResult="0"/></dt:objectInstance></dt:predicate></dt:not></dp:condition></dp:route>
   <dp:route><dp:source>q</dp:source><dp:destination>fact</dp:destination></dp:route>
   <dp:route><dp:source>@all - (fact + rest)</dp:source><dp:destination>rest</dp:destination>
     <dp:mapExpression expression="received = Record {receivedRecord}"/>
     <dp:condition><dt:not><dt:predicate><dp:eventType>routing:record-has-been-delivered</dp:eventType></dt:predicate></dt:not></dp:condition></dp:route>
  </network>
 </process>
</processes>"""
LINES = ['[12],"x y"', '[zz],"x"', '[1],"a\\"b"', '[1],"a,b"', "[1],", '[1],"a', "1,a,b"]

CSV = StreamFormat(("aa", "bb"), ",", "\\", (), {"aa": ColumnFormat(quotes=(("[", "]"),)), "bb": ColumnFormat(quotes=(('"', '"'),))})
WANT = [["12", "x y"], ["zz", "x"], ["1", 'a"b'], ["1", "a,b"], ["1", ""], ["1", "a"], None]


def python_values(line, f):
    try:
        return values(line, column_formats(f))
    except ParseError:
        return None


def test_golden_lines(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    assert [r.p for r in df.select("i", split_line(F.col("line"), CSV).alias("p")).orderBy("i").collect()] == WANT
    assert [python_values(x, CSV) for x in LINES] == WANT


def test_tokens_and_long_sequences():
    f = StreamFormat(("a", "b"), "::", "^", (("<<", ">>"),), {"b": ColumnFormat(separators=("/",))})
    assert compiled(column_formats(f)) is None
    assert tokenize("x<<y::z>>^:::p/q", column_formats(f)) == [
        [("WORD", "x"), ("QUOTE", "<<"), ("WORD", "y::z"), ("QUOTE", ">>"), ("ESCAPE", "^"), ("WORD", ":"), ("DELIMITER", "::")],
        [("WORD", "p"), ("TOKENSEPARATOR", "/"), ("WORD", "q")],
    ]
    assert values("a::b/c", column_formats(f)) == ["a", "b/c"]
    assert values("a::<<b/c::d>>", column_formats(f)) == ["a", "b/c::d"]


def test_bad_formats():
    for f in (StreamFormat(("a",), ",", ","), StreamFormat(("a",), "::", ":"), StreamFormat(("a",), "", "\\")):
        with pytest.raises(DefinitionError):
            column_formats(f)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab[]",\\ \n\x01\x00', max_size=9), min_size=40, max_size=120))
def test_pattern_and_tokenizer_agree(spark, xs):
    """Both ways of reading a line give the same values and reject the same lines."""
    assert compiled(column_formats(CSV)) is not None
    got = spark.createDataFrame(list(enumerate(xs)), "i int, line string").select("i", split_line(F.col("line"), CSV).alias("p")).collect()
    for r in got:
        assert r.p == python_values(xs[r.i], CSV), xs[r.i]


def test_encodings_blank_lines_and_missing_files(spark, tmp_path):
    text = "p\x01q\n\n  \nőrült, ä|x\r\nlast"
    want = ["p\x01q", "", "  ", "őrült, ä|x", "last"]
    for encoding in ("UTF-8", "ISO-8859-2", "UTF-16LE", "windows-1250"):
        (tmp_path / encoding).write_bytes(text.encode(encoding))
        assert [r.line for r in files.read_lines(spark, [str(tmp_path / encoding)], encoding).collect()] == want, encoding
    (tmp_path / "latin").write_bytes("p\x01q\n\n  \nä".encode("latin-1"))
    assert [r.line for r in files.read_lines(spark, [str(tmp_path / "latin")], "ISO-8859-1").collect()] == ["p\x01q", "", "  ", "ä"]
    missing = []
    got = files.read_lines(spark, [str(tmp_path / "nowhere"), str(tmp_path / "UTF-8"), str(tmp_path / "no*")], on_missing=missing.append)
    assert got.count() == 5 and missing == [str(tmp_path / "nowhere"), str(tmp_path / "no*")]
    assert files.read_lines(spark, [str(tmp_path / "nowhere")], on_missing=missing.append).count() == 0


def test_export_and_round_trip(spark):
    f = StreamFormat(("a", "b", "c"), "|", "\\", ())
    df = spark.createDataFrame([("x", None, "1|2"), ("", "y\\z", "w")], "a string, b string, c string")
    assert [r.v for r in df.select(export_line([F.col(c) for c in "abc"], f).alias("v")).collect()] == ["x||1|2", "|y\\z|w"]
    back = df.select(split_line(export_line([F.col(c) for c in "abc"], f, escape=True), f).alias("p")).collect()
    assert [r.p for r in back] == [["x", "", "1|2"], ["", "y\\z", "w"]]


def test_files(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_bytes("\r\n".join(["äb|c", "d|e"]).encode("latin-1"))
    assert sorted(r.line for r in files.read_lines(spark, [str(src)], "ISO-8859-1").collect()) == ["d|e", "äb|c"]
    files.write_lines(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a|"]
    with pytest.raises(DefinitionError):
        files.read_lines(spark, [])
    with pytest.raises(DefinitionError):
        files.as_strings(spark.range(1), 2)
    assert files.as_strings(spark.range(2), 1).dtypes == [("id", "string")]
    assert files.as_strings(spark.range(2), 1, {"ID": -5}).count() == 2
    for types in ({"id": 12}, {"id": 999}, {"other": 12}):
        with pytest.raises(DefinitionError):
            files.as_strings(spark.range(2), 1, types)


def run(spark):
    from millrace import suite  # noqa: F401  registers first_word

    return plan(load(XML)["two"], {"log": spark.createDataFrame([(x,) for x in LINES], "line string")})


def test_xml_process(spark):
    p = load(XML)["two"]
    assert p.inputs[0].format.columns["aa"].quotes == (("[", "]"),) and p.pipes[0].name == "q" and p.nodes[0].tasks[0].function == "first_word"
    got = run(spark)
    assert sorted(map(tuple, got.sinks["fact"].collect())) == sorted([("12", "x y", "x"), ("0", "x", "x"), ("1", 'a"b', 'a"b'), ("1", "a,b", "a,b"), ("1", "", ""), ("1", "a", "a")])
    assert got.sinks["rest"].count() == 0 and got.discarded["log"].count() == 1


def test_monitor_report(spark):
    seen = []
    m = Monitor(on_node=lambda n, k: seen.append((n, k)), on_error=lambda w, k: seen.append((w, k)))
    got = report(run(spark), m)
    assert ("n", 6) in seen and [k for n, k in seen if n == "log"] == [1, 2, 3, 4, 5, 6, 1]  # each of six records, then one bad line and got["process"] == "two"


def test_stream_equals_batch(spark, tmp_path):
    import time

    from millrace.streaming.run import start
    from millrace.streaming.samples import Samples

    (tmp_path / "in").mkdir()
    for i, x in enumerate(LINES):
        (tmp_path / "in" / f"{i}.txt").write_text(x + "\n")
    samples = Samples(most=2)
    spark.streams.addListener(samples)
    queries = start(spark, load(XML)["two"], {"log": str(tmp_path / "in")}, str(tmp_path / "out"), str(tmp_path / "ck"), max_files=2)
    for q in queries:
        q.awaitTermination(60)
    for _ in range(100):  # the listener hears of batches a little later
        if all(samples.taken.get(str(q.runId)) for q in queries):
            break
        time.sleep(0.1)
    spark.streams.removeListener(samples)
    for q in queries:
        taken = samples.taken[str(q.runId)]
        assert 1 <= len(taken) <= 2 and all(x.size > 0 and x.head and x.date for x in taken)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "fact")).collect())
    assert got == sorted(r.value for r in files.lines_of(run(spark).sinks["fact"]).collect())


def test_command_line(spark, tmp_path):
    (tmp_path / "p.xml").write_text(XML)
    (tmp_path / "in.txt").write_text("\n".join(LINES))
    args = ["--process_definitions", str(tmp_path / "p.xml"), "--output", str(tmp_path / "o"), "--tasks", "millrace.suite", str(tmp_path / "in.txt")]
    assert cli.main(["--process", "two", *args]) == 0 and cli.main(["--process", "none", *args]) == 2
    assert spark.read.text(str(tmp_path / "o" / "fact")).count() == 6 and spark.read.json(str(tmp_path / "o" / "log.discarded")).count() == 1


def test_command_line_exports(spark, tmp_path):
    (tmp_path / "p.xml").write_text(XML)
    (tmp_path / "in.txt").write_text("\n".join(LINES))
    for name, classes in (("good", "millrace.suite.Halver"), ("bad", "millrace.nothing.Here"), ("none", "nowhere.Here")):
        (tmp_path / f"{name}.xml").write_text(f"<exports><class>{classes}</class></exports>")
    args = ["--process", "two", "--process_definitions", str(tmp_path / "p.xml"), "--output", str(tmp_path / "o"), str(tmp_path / "in.txt")]
    assert cli.main(["--exports", str(tmp_path / "good.xml"), *args]) == 0 and cli.main(["--exports", str(tmp_path / "none.xml"), *args]) == 2
    assert cli.main(["--exports", str(tmp_path / "bad.xml"), *args]) == 2
    assert cli.main(["--exports", str(tmp_path / "missing.xml"), *args]) == 2


def test_command_line_options(spark, tmp_path, capsys):
    import json

    (tmp_path / "p.xml").write_text(XML)
    (tmp_path / "a.txt").write_text('[1],"x"\n[2],"y"\nbad,line,here')
    (tmp_path / "b.txt").write_text('[3],"z"\n[4],"x"\n')
    run = lambda name, cache, *more: cli.main(["--process=two", f"--process_definitions={tmp_path}/p.xml", f"--output={tmp_path}/{name}", f"--data={tmp_path}/data", f"--usecache={cache}", "--tasks=millrace.suite", "--lookup=fact.bb", *more])
    assert run("one", "false", "--keepkeyset=true", "--report", "--input", f"log={tmp_path}/a.txt", "--input", f"log={tmp_path}/gone.txt") == 0
    told = json.loads(capsys.readouterr().out)
    n = {(r["kind"], r["source"], r["destination"]): r["n"] for r in told["counts"]}
    assert n["element", "log", ""] == 2 and n["route", "q", "fact"] == 2 and n["element", "fact", ""] == 2 and told["errors"] == {"log": 1}
    assert told["events"] == [["file-open-failed", f"{tmp_path}/gone.txt"]]
    meta = (tmp_path / "one" / "meta.xml").read_text()
    assert "file@" in meta and 'name="two"' in meta and "programStart" in meta
    keys = lambda out: {r.key: r.id for r in spark.read.parquet(f"{tmp_path}/{out}/keys/bb").collect()}
    assert keys("one") == {"x": 0, "y": 1}
    assert run("two", "true", "--keepkeyset=true", f"{tmp_path}/b.txt") == 0
    assert keys("two") == {"x": 0, "y": 1, "z": 2}
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/two/fact").collect()) == ["3|z|2", "4|x|0"]
    assert run("three", "false", f"{tmp_path}/b.txt") == 0 and not (tmp_path / "three" / "keys").exists()
    assert run("four", "false", "--resolve=fact.nothing", f"{tmp_path}/b.txt") == 2 and run("five", "false", "--input=none=x") == 2


def test_resources_and_view_formats(spark):
    bound = XML.replace("<datasource>", '<datasource><ioResource name="r"><file location="/in/log"/></ioResource>', 1)
    assert load(bound)["two"].inputs[0].resource.location == "/in/log"
    db = XML.replace("<datasource>", '<datasource><ioResource name="r"><db connection="jdbc:x" table="t"/></ioResource>', 1)
    from millrace.monitor import bound as told

    assert told(load(db)["two"].inputs[0]) == "db@jdbc:x,t" and told(load(bound)["two"].inputs[0]) == "file@/in/log"
    with pytest.raises(DefinitionError):
        load(XML.replace("<datasource>", '<datasource><ioResource name="r"/>', 1))
    body = XML[XML.index("<df:streamFormat>") : XML.index("</df:format>")]
    spark.createDataFrame([("7", "q r"), ("z", "s")], "aa string, bb string").createOrReplaceTempView("log")
    from millrace import suite  # noqa: F401  registers first_word

    got = plan(load(XML.replace(body, "<df:tmpFormat/>"))["two"], {})
    assert sorted(map(tuple, got.sinks["fact"].collect())) == [("0", "s", "s"), ("7", "q r", "q")] and got.sinks["rest"].count() == 0


def test_shared_and_table_formats():
    shared = XML.replace("<df:format>", "<df:formatRef>f</df:formatRef><df:skip>", 1).replace("</df:format>", "</df:skip>", 1)
    body = XML[XML.index("<df:streamFormat>") : XML.index("</df:format>")]
    whole = shared.replace("<process ", f'<df:format name="f">{body}</df:format><process ', 1)
    assert load(whole)["two"].inputs[0].format == load(XML)["two"].inputs[0].format
    with pytest.raises(DefinitionError):
        load(shared)
    table = XML.replace(body, '<df:tableFormat><df:fields><df:column name="x" jdbcDataType="12"/></df:fields></df:tableFormat>')
    assert load(table)["two"].inputs[0].format.fields == ("x",)


def test_streaming_dictionary(spark, tmp_path):
    from millrace.streaming import dictionary

    (tmp_path / "in").mkdir()
    for i, keys in enumerate((["b", "a"], ["a", "c"], ["d", "b"])):
        spark.createDataFrame([(10 * i + k, x) for k, x in enumerate(keys)], "n long, k string").coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("n long, k string").json(str(tmp_path / "in" / "*"))
        dictionary.start(stream, "k", "n", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {r.key: r.id for r in dictionary.read(spark, str(tmp_path / "out")).collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}
