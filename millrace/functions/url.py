"""URL decomposition, normalisation and re-assembly as Column expressions.

The rules are those of the log processor, not of RFC 3986: without a question
mark a fragment stays part of the path, the port is 80 unless one is given, a
parameter with more than one equals sign loses its value, empty path segments
and trailing slashes vanish, and a URL without schema or host is a failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names that stand for their directory (fixed values).
INDEX_FILES = ["index.html", "index.htm", "index.php", "default.asp"]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def cut(s: Column, mark: str) -> Column:
    """Struct of what stands before and after the first mark; all before if there is none."""
    return let(s, lambda x: let(F.locate(mark, x), lambda at: F.struct(
        F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x).alias("head"),
        F.when(at > 0, F.substring(x, at + len(mark), F.length(x))).otherwise(F.lit("")).alias("tail"))))


def _nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def _pair(p: Column) -> Column:
    return let(F.split(F.regexp_replace(p, "=+\\z", ""), "="), lambda parts: F.struct(parts[0].alias("name"), F.when(F.size(parts) == 2, parts[1]).alias("value")))


def components(url: Column) -> Column:
    """Struct of schema, hosts, port, segments, params (array of name, value), fragment, isdir; null if malformed."""

    def built(schema, auth, path, query):
        port = F.get(F.split(auth, ":"), F.lit(1)).try_cast("int")
        return F.struct(
            schema.alias("schema"),
            F.split(F.split(auth, ":")[0], r"\.").alias("hosts"),
            F.coalesce(F.nullif(port, F.lit(0)), F.lit(80)).alias("port"),
            _nonempty(F.split(path, "/")).alias("segments"),
            F.transform(_nonempty(F.split(query["head"], "&")), _pair).alias("params"),
            query["tail"].alias("fragment"),
            F.lit(False).alias("isdir"),
        )

    # a label may not be empty, and only digits may follow the one colon
    fine = url.rlike(r"(?s)\A.+?://[^.:/]+(\.[^.:/]+)*(:[0-9]+)?(/.*)?\z")
    whole = let(cut(url, "://"), lambda a: let(cut(a["tail"], "/"), lambda b: let(cut(b["tail"], "?"), lambda c: let(cut(c["tail"], "#"), lambda q: built(a["head"], b["head"], c["head"], q)))))
    return F.when(fine, whole)


def normalise(c: Column) -> Column:
    return let(c, _normalise)


def _normalise(c: Column) -> Column:
    """Lower-case host without a leading www, no index file, no dot segments, parameters in order of name (stable)."""
    segments = c["segments"]
    last = F.get(segments, F.size(segments) - 1)
    index = F.coalesce(last.isin(INDEX_FILES), F.lit(False))
    kept = F.when(index, F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(segments)
    walked = lambda kept: F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    hosts = F.transform(c["hosts"], F.lower)
    hosts = F.when(hosts[0] == "www", F.slice(hosts, F.lit(2), F.size(hosts))).otherwise(hosts)
    numbered = F.transform(c["params"], lambda p, i: F.struct(p["name"].alias("name"), i.alias("i"), p["value"].alias("value")))
    params = F.transform(F.array_sort(numbered), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))
    got = F.struct(c["schema"].alias("schema"), hosts.alias("hosts"), c["port"].alias("port"), walked(kept).alias("segments"), params.alias("params"), c["fragment"].alias("fragment"), (index | (F.size(kept) == 0)).alias("isdir"))
    return F.when(c.isNotNull(), got)


def parameters(c: Column) -> Column:
    return F.array_join(F.transform(c["params"], lambda p: F.concat(p["name"], F.when(p["value"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), p["value"])))), "&")


def full(c: Column) -> Column:
    """The URL put together again; port 80 is left out."""
    return let(c, lambda x: let(parameters(x), lambda params: _full(x, params)))


def _full(c: Column, params: Column) -> Column:
    path = F.array_join(c["segments"], "/")
    return F.concat(
        c["schema"], F.lit("://"), F.array_join(c["hosts"], "."),
        F.when(c["port"] != 80, F.concat(F.lit(":"), c["port"].cast("string"))).otherwise(F.lit("")),
        F.when(F.size(c["segments"]) > 0, F.lit("/")).otherwise(F.lit("")), path,
        F.when(c["isdir"], F.lit("/")).otherwise(F.lit("")),
        F.when((F.length(params) > 0) | (F.length(c["fragment"]) > 0), F.lit("?")).otherwise(F.lit("")), params,
        F.when(F.length(c["fragment"]) > 0, F.lit("#")).otherwise(F.lit("")), c["fragment"],
    )


FIELDS = ["schema", "host", "port", "path", "isdir", "parameters", "fragment", "fullurl"]


def fields(c: Column) -> Column:
    """The eight output fields, as strings."""
    return let(c, _fields)


def _fields(c: Column) -> Column:
    got = F.struct(
        c["schema"].alias("schema"), F.array_join(c["hosts"], ".").alias("host"), c["port"].cast("string").alias("port"),
        F.array_join(c["segments"], "/").alias("path"), c["isdir"].cast("string").alias("isdir"), parameters(c).alias("parameters"),
        c["fragment"].alias("fragment"), full(c).alias("fullurl"),
    )
    return F.when(c.isNotNull(), got)


def plain_url(url: Column) -> Column:
    """state and fields of the normalised URL; malformed ones are a FAILURE."""
    return let(fields(normalise(components(url))), lambda f: F.struct(F.when(f.isNotNull(), F.lit("OK")).otherwise(F.lit("FAILURE")).alias("state"), f.alias("fields")))


def http_request(request: Column) -> Column:
    """`host,METHOD document [protocol]`: httprequest, document, protocol, state and the URL's fields."""

    def built(host, words):
        method, document, protocol = (F.nullif(F.get(words, F.lit(i)), F.lit("")) for i in range(3))
        ok = (host != "") & method.isNotNull() & document.isNotNull()
        url = fields(components(F.concat(F.lit("http://"), host, document)))
        return F.struct(
            F.when(ok, F.lit("OK")).otherwise(F.lit("FAILURE")).alias("state"), F.when(ok, method).alias("httprequest"),
            F.when(ok, document).alias("document"), F.when(ok, protocol).alias("protocol"), F.when(ok, url).alias("url"),
        )

    return let(cut(request, ","), lambda a: let(F.split(a["tail"], " "), lambda words: built(a["head"], words)))
