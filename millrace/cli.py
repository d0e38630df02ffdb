"""Command line: runs one process of a definitions file over text files."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import os
import sys
import time
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.netaddr import asked, host_engine
from millrace.monitor import log_monitor, report, report_xml
from millrace.operators.enrich import CACHE
from millrace.operators.keyset import encode
from millrace.plans.model import DefinitionError
from millrace.plans.planner import plan
from millrace.plans.xmlconfig import exports, load
from millrace.sources.files import read_lines, write_lines
from millrace.sources.store import Store

log = logging.getLogger("millrace")


def truth(s: str) -> bool:
    if s not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return s == "true"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--process", required=True, help="name of the process to run")
    p.add_argument("--process_definitions", default=os.environ.get("MILLRACE_DEFINITIONS"), help="XML file of definitions")
    p.add_argument("--output", required=True, help="folder for the sinks' files")
    p.add_argument("--data", default="resources", help="folder of what outlives a run: data/dictionary holds keysets and host names")
    p.add_argument("--usecache", type=truth, default=False, help="go on from the dictionary in the data folder (true or false)")
    p.add_argument("--keepkeyset", type=truth, default=False, help="leave the keysets in keys/ of the output folder (true or false)")
    p.add_argument("--nameserver", help="name server (host or host:port) for --resolve")
    p.add_argument("--lookup", action="append", default=[], metavar="SINK.COLUMN", help="replace a sink's column by ids and write its lookup table")
    p.add_argument("--resolve", action="append", default=[], metavar="SINK.COLUMN", help="add hostname, of a sink's column of addresses")
    p.add_argument("--tasks", action="append", default=[], help="Python modules that register tasks")
    p.add_argument("--exports", action="append", default=[], metavar="FILE.xml", help="lists of Python modules and classes that register tasks, conversions and predicates")
    p.add_argument("--input", action="append", default=[], metavar="NAME=FILE", help="a file for the input of that name; may be repeated")
    p.add_argument("--report", action="store_true", help="count records while they are written; print a report and write meta.xml")
    p.add_argument("files", nargs="*", help="input files, for the process's one input")
    return p


def split_columns(spark: SparkSession, a: argparse.Namespace, sinks: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """The sinks with host names added and columns replaced by ids. Lookup tables and keysets are written here; what is kept in memory for them is given back."""
    dictionary = Store(spark, os.path.join(a.data, "dictionary"))
    sinks, kept = dict(sinks), []
    for kind, named in (("resolve", a.resolve), ("lookup", a.lookup)):
        for name in named:
            sink, _, column = name.partition(".")
            if sink not in sinks or column not in sinks[sink].columns:
                raise DefinitionError(f"no sink and column {name!r}")
            if kind == "resolve":
                if not a.nameserver:
                    raise DefinitionError("--resolve needs --nameserver")
                got, entries = host_engine(sinks[sink], column, asked(a.nameserver), dictionary.read("hostnames", CACHE) if a.usecache else None)
                entries = dictionary.write("hostnames", entries)
                sinks[sink] = sinks[sink].join(entries.select(F.col("key").alias(column), F.col("fields")["hostname"].alias("hostname")), column, "left").select(*got.drop("state").columns)
                continue
            if not a.usecache:
                dictionary.drop(column)
            rows = sinks[sink].withColumn("_row", F.monotonically_increasing_id()).persist()
            kept.append(rows)
            ids = dictionary.keyset(column, rows, column, "_row")
            if a.keepkeyset:
                ids.write.mode("overwrite").parquet(os.path.join(a.output, "keys", column))
            write_lines(ids.select("id", "key"), os.path.join(a.output, f"{column}.lookup"))
            sinks[sink] = encode(rows.drop("_row"), column, ids)
    return sinks, kept


def main(argv: list[str] | None = None) -> int:
    a, began = parser().parse_args(argv), time.time()
    try:
        for module in a.tasks:
            importlib.import_module(module)
        for path in a.exports:
            exports(path)
    except (OSError, ImportError, DefinitionError, ET.ParseError) as e:
        log.error("exports: %s", e)
        return 2
    if not a.process_definitions:
        log.error("no definitions: give --process_definitions or set MILLRACE_DEFINITIONS")
        return 2
    with open(a.process_definitions, encoding="utf-8") as f:
        found = load(f.read())
    if a.process not in found:
        log.error("no process %r; there are: %s", a.process, ", ".join(sorted(found)))
        return 2
    p, monitor = found[a.process], log_monitor()
    files: dict[str, list[str]] = {t.name: [] for t in p.inputs if not (t.format and t.format.view)}
    for x in a.input:
        name, _, path = x.partition("=")
        if name not in files:
            log.error("process %s has no input %r", p.name, name)
            return 2
        files[name].append(path)
    if a.files:
        if len(files) != 1:
            log.error("process %s has %d inputs: give files by --input NAME=FILE", p.name, len(files))
            return 2
        next(iter(files.values())).extend(a.files)
    spark = SparkSession.builder.appName(f"millrace-{p.name}").getOrCreate()
    encodings = {t.name: t.format.encoding if t.format else "UTF-8" for t in p.inputs}
    try:
        sources = {name: read_lines(spark, paths, encodings[name], lambda path: monitor.custom("file-open-failed", path)) for name, paths in files.items()}
        got = plan(p, sources, observe=a.report)
        sinks, kept = split_columns(spark, a, got.sinks)
    except DefinitionError as e:
        log.error("process %s: %s", p.name, e)
        return 2
    formats = {t.name: t.format for t in p.outputs}
    for sink, df in sinks.items():
        write_lines(df, os.path.join(a.output, sink), formats.get(sink) if sink not in {x.partition(".")[0] for x in a.lookup + a.resolve} else None)
    for source, df in got.discarded.items():
        df.write.mode("overwrite").json(os.path.join(a.output, f"{source}.discarded"))
    if a.report:
        told = report(got, monitor, began)
        print(json.dumps(told, sort_keys=True))
        bound = {name: ",".join(f"file@{x}" for x in paths) for name, paths in files.items()} | {s: f"file@{os.path.join(a.output, s)}" for s in sinks}
        with open(os.path.join(a.output, "meta.xml"), "w", encoding="utf-8") as f:
            f.write(report_xml(told, bound))
    for df in kept:
        df.unpersist()
    got.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
