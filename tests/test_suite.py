"""Every query of the suite against its SQL, and functions against golden rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import suite
from millrace.functions import url
from millrace.functions.useragent import classify, load_dictionary, products
from millrace.operators import enrich, keyset

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(suite.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = suite.QUERIES[name](spark, SF)
    want = duck.sql(suite.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_every_query_has_an_oracle():
    assert set(suite.QUERIES) == set(suite.ORACLE_SQL)


@pytest.mark.parametrize("text,want", [
    ("http://www.Example.com/a/../b/./index.html?z=1&a=2#f", "http://example.com/b/?a=2&z=1#f"), ("http://x.y:8080", "http://x.y:8080/"), ("https://x.y/a#frag", "https://x.y/a#frag"),
    ("http://x.y/?a=b=c&d=&e", "http://x.y/?a&d&e"), ("HTTP://X.y:80/p//q/", "HTTP://x.y/p/q"), ("x.y/a", None), ("http:///a", None), ("http://a..b/", None), ("http://a:b:1/", None), (None, None),
])
def test_url_normalisation(spark, text, want):
    got = spark.createDataFrame([(text,)], "u string").select(url.full(url.normalise(url.components(F.col("u")))).alias("f")).first().f
    assert got == want


def test_url_states(spark):
    got = spark.createDataFrame([("h.x,GET /a?b=1 HTTP/1.0",), ("h.x,GET",), (",GET /a",), ("h.x,POST /a",)], "r string").select(url.http_request(F.col("r")).alias("r")).collect()
    assert [(x.r.state, x.r.httprequest, x.r.document, x.r.protocol) for x in got] == [("OK", "GET", "/a?b=1", "HTTP/1.0"), ("FAILURE", None, None, None), ("FAILURE", None, None, None), ("OK", "POST", "/a", None)]
    assert got[0].r.url.fullurl == "http://h.x/a?b=1"


@pytest.mark.parametrize("ua,want", [
    ("Mozilla/5.0 (X11; U; Linux i686; en-US; rv:1.8) Gecko/20051111", {"agentLanguage": "en-US", "agentProcessor": "I686", "layoutEngine": "Gecko", "agentDevice": "COMPUTER", "agentSWPlatform": "UNIX"}),
    ("Opera/9.80 (Windows CE; 240x320; en) Presto/2.2", {"agentName": "Opera", "agentOSVersion": "CE", "agentDevice": "PDA", "layoutResolution": "240x320"}),
    ("Googlebot/2.1 (+http://www.google.com/bot.html)", {"agentName": "Googlebot", "agentType": "ROBOT"}),
    ("libwww-perl/5.8", {"agentName": "libwww-perl", "agentType": "ROBOT"}),
    ("Wget/1.10 (Debian 3.1)", {"agentName": "Wget", "agentVersion": "1.10", "agentOS": "Linux", "agentOSDistro": "Debian", "agentOSVersion": "3.1"}),
])
def test_user_agents(ua, want):
    got = classify(ua) or {}
    assert {k: got.get(k) for k in want} == want


def test_user_agent_dictionaries():
    own = load_dictionary('<userAgentConfig><setBrowserName pattern="Fox"><type>ROBOT</type><engine>E</engine></setBrowserName><identifyDevice pattern="Pad">PHONE</identifyDevice><setBrowserName pattern="Fox"><type>STANDARD_BROWSER</type><lowpriority/></setBrowserName></userAgentConfig>')
    got = classify("Fox/1 (Pad 2) Other/3", dictionary=own)
    assert (got["agentName"], got["agentVersion"], got["agentType"], got["agentDevice"], got["layoutEngine"]) == ("Other", "3", "STANDARD_BROWSER", "PHONE", None)
    assert classify("Opera/9", dictionary=own)["agentType"] == "UNKNOWN" and classify("Opera/9")["agentType"] == "STANDARD_BROWSER"


def test_user_agent_edges():
    assert classify(None) is None and classify("   ") is None and classify("(x)") is None
    assert classify("Opera/9.8 Version/10.10")["agentVersion"] == "Version"
    assert classify("Opera/9.8 Version/10.10", fix_version=True)["agentVersion"] == "10.10"
    assert classify("Mozilla/5.0 (X11; rv:1.8)", fix_version=True)["agentName"] == "Mozilla Suite"
    assert [(p.name, p.version, p.language, p.details) for p in products("A b/1 [en] (x; (y) ;) C/2")] == [("A b", "1", "en", ("x", "y")), ("C", "2", None, ())]


def test_keyset_is_dense_and_first_seen(spark):
    rows = [(i, f"k{(i * 7) % 13}") for i in range(60)] + [(99, None)]
    got = {r.key: r.id for r in keyset.keyset(spark.createDataFrame(rows, "n long, k string"), "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(dict.fromkeys(k for _, k in rows if k))}
    text = keyset.keyset(spark.createDataFrame([("b", "x"), ("a", "y")], "n string, k string"), "k", "n")
    assert {r.key: r.id for r in text.collect()} == {"y": 0, "x": 1}
    assert keyset.keyset(spark.createDataFrame([], "n long, k string"), "k", "n").count() == 0


def test_keyset_orders_of_any_type(spark):
    import datetime as dt

    for value, kind in ((lambda i: dt.date(2024, 1, 1) + dt.timedelta(i % 9), "date"), (lambda i: f"t{i % 9}", "string"), (lambda i: None, "string"), (lambda i: bytes([i % 9]), "binary"), (lambda i: dt.datetime(2024, 1, 1, i % 9), "timestamp_ntz")):
        rows = [(value(i), f"k{i * 7 % 40:02}") for i in range(80)]
        first = {k: min(v for v, x in rows if x == k) if value(0) is not None else 0 for _, k in rows}
        got = {r.key: r.id for r in keyset.keyset(spark.createDataFrame(rows, f"n {kind}, k string"), "k", "n").collect()}
        assert got == {k: i for i, k in enumerate(sorted(first, key=lambda k: (first[k], k)))}, kind


def test_name_server_answers(spark):
    """A name server of our own on this machine: a name behind a pointer, no name, and silence."""
    import socket
    import struct
    import threading

    from millrace.functions import netaddr

    server = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    server.bind(("127.0.0.1", 0))

    def serve():
        while True:
            packet, peer = server.recvfrom(512)
            name, _ = netaddr.read_name(packet, 12)
            if name.startswith("0."):
                return server.close()
            found = name.startswith("7.")
            head = packet[:2] + struct.pack(">5H", 0x8180 if found else 0x8183, 1, int(found), 0, 0)
            answer = b"\xc0\x0c" + struct.pack(">2HIH", 12, 1, 60, 10) + b"\x04host\x03net\x00" if found else b""
            server.sendto(head + packet[12:] + answer, peer)

    threading.Thread(target=serve, daemon=True).start()
    at = f"127.0.0.1:{server.getsockname()[1]}"
    df = spark.createDataFrame([("10.0.0.7",), ("10.0.0.8",), ("no address",), ("10.0.0.7",), (None,)], "ip string")
    got, entries = netaddr.host_engine(df, "ip", netaddr.asked(at, timeout=1.0, tries=1))
    assert sorted((r.ip or "", r.hostname, r.state) for r in got.collect()) == [("", None, None), ("10.0.0.7", "host.net", "OK"), ("10.0.0.7", "host.net", "OK"), ("10.0.0.8", None, "FAILURE"), ("no address", None, "FAILURE")]
    assert entries.count() == 3 and netaddr.ptr_answer(b"\x00\x01\x81\x80" + bytes(8), 2) is None
    socket.socket(socket.AF_INET, socket.SOCK_DGRAM).sendto(netaddr.ptr_query("1.1.1.0", 1), server.getsockname())


def test_store_keeps_what_a_failed_run_leaves(spark, tmp_path):
    from millrace.sources.store import KEYS, Store

    store = Store(spark, str(tmp_path))
    assert store.names() == [] and store.read("k", KEYS).count() == 0
    for i in range(3):
        store.write("k", spark.createDataFrame([(i, "x")], KEYS))
    (tmp_path / "k" / "v=9").mkdir()  # a run that did not finish
    assert store.versions("k") == [1, 2] and store.read("k", KEYS).first().id == 2 and store.names() == ["k"]
    store.drop("k")
    assert store.names() == []


def test_record_dates_and_odd_entries(spark):
    from millrace.operators import records

    df = spark.createDataFrame([("a:1|bad|a:2:3|ProcessedDataInternalState:FAILURE|timestamp:2024-01-02 03:04:05",), ("",), (None,), ("timestamp:never",)], "t string")
    got = [r.r for r in df.select(records.unserialize(F.col("t")).alias("r")).collect()]
    assert got[0].fields == {"a": "2:3"} and got[0].state == "FAILURE" and got[0].timestamp.hour == 3 and got[0].dataSourceModified is None
    assert [(x.fields or {}, x.state, x.timestamp) for x in got[1:]] == [({}, "UNDEFINED", None)] * 3
    empty = spark.range(1).select(records.serialize(F.expr("cast(map() as map<string,string>)"), F.lit("OK")).alias("t")).first().t
    assert empty == "ProcessedDataInternalState:EMPTY"


def test_enrichment_computes_each_missing_key_once(spark):
    asked = []

    def compute(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        return keys.select("key", F.create_map(F.lit("v"), F.upper("key")).alias("fields"), F.lit("OK").alias("state"))

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    got, entries = enrich.enrich(df, "k", compute)
    assert sorted((r.k or "", (r.fields or {}).get("v")) for r in got.collect()) == [("", None), ("a", "A"), ("a", "A"), ("b", "B")]
    again, entries = enrich.enrich(df.union(spark.createDataFrame([("c",)], "k string")), "k", compute, entries)
    assert again.count() == 5 and entries.count() == 3 and asked[1] == ["c"]
