"""Readers and writers of terminals: text files, tables and JDBC queries."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.model import DEFAULT_SINK, DefinitionError, StreamFormat
from millrace.sources.formats import export_line


log = logging.getLogger("millrace")
#: Encodings that Spark decodes itself.
NATIVE = {"US-ASCII", "ISO-8859-1", "UTF-16BE", "UTF-16LE"}


def decoded(raw: Column, encoding: str) -> Column:
    """The text of bytes; what the encoding does not know becomes the replacement character."""
    if encoding.upper() in NATIVE:
        return F.decode(raw, encoding.upper())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else bytes(x).decode(encoding, "replace"))

    return run(raw)


def readable(spark: SparkSession, paths: list[str], on_missing: Callable[[str], None]) -> list[str]:
    """The paths (wildcards allowed) at which something is found; the others are told."""
    found = []
    for p in paths:
        try:
            spark.read.text(p)
            found.append(p)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            on_missing(p)
    return found


def read_lines(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", on_missing: Callable[[str], None] | None = None) -> DataFrame:
    """(line, file) of all files. Files that cannot be found are told to on_missing
    (or logged) and left out, and so are those that are gone by the time of reading."""
    if not paths:
        raise DefinitionError("no input files")
    found = readable(spark, paths, on_missing or (lambda p: log.error("cannot open %s", p)))
    if not found:
        return spark.createDataFrame([], "line string, file string")
    reader = spark.read.option("ignoreMissingFiles", "true")
    if encoding.upper().replace("-", "") == "UTF8":
        value = F.col("value")
        df = reader.option("lineSep", "\n").text(found)
    else:  # lines are cut at the encoded newline, as bytes, and then decoded
        df = reader.option("encoding", encoding).option("lineSep", "\n").text(found)
        value = decoded(F.col("value").cast("binary"), encoding)
    return df.select(F.regexp_replace(value, "\r\\z", "").alias("line"), F.input_file_name().alias("file"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.regexp_replace("value", "\r\\z", "").alias("line"))


def read_jdbc(spark: SparkSession, url: str, query: str, columns: int, user: str | None = None, password: str | None = None, driver: str | None = None, types: dict[str, int] | None = None, **partitioning) -> DataFrame:
    """A query's rows as strings; the number of columns must be as declared.
    partitioning: Spark's partitionColumn, lowerBound, upperBound, numPartitions."""
    options = {"url": url, "user": user, "password": password, "driver": driver}
    reader = spark.read.format("jdbc").options(**{k: v for k, v in options.items() if v is not None})
    reader = reader.options(dbtable=f"({query}) q", **partitioning) if partitioning else reader.option("query", query)
    return as_strings(reader.load(), columns, types)


#: JDBC type codes of table formats, and what they may be in Spark (fixed values).
JDBC_TYPES = {
    -7: ("boolean",), -6: ("tinyint",), -5: ("bigint",), 1: ("string",), 2: ("decimal",), 3: ("decimal",), 4: ("int",), 5: ("smallint",), 6: ("double", "float"),
    7: ("float",), 8: ("double",), 12: ("string",), 16: ("boolean",), 91: ("date",), 92: ("timestamp",), 93: ("timestamp", "timestamp_ntz"),
}


def as_strings(df: DataFrame, columns: int, types: dict[str, int] | None = None) -> DataFrame:
    """types: JDBC type codes by column name, as a table format declares them."""
    if len(df.columns) != columns:
        raise DefinitionError(f"the query gives {len(df.columns)} columns, not {columns}")
    kinds = {c.lower(): t.split("(")[0] for c, t in df.dtypes}
    for name, code in (types or {}).items():
        if kinds.get(name.lower()) not in JDBC_TYPES.get(code, ()):
            raise DefinitionError(f"column {name} is {kinds.get(name.lower(), 'missing')}, not of JDBC type {code}")
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def lines_of(df: DataFrame, f: StreamFormat | None = None, escape: bool = False) -> DataFrame:
    f = f or DEFAULT_SINK
    cols: list[Column] = [F.col(f"`{c}`") for c in (f.fields or df.columns)]
    return df.select(export_line(cols, f, escape).alias("value"))


def write_lines(df: DataFrame, path: str, f: StreamFormat | None = None, escape: bool = False) -> None:
    f = f or DEFAULT_SINK
    lines_of(df, f, escape).write.mode("overwrite").option("lineSep", f.newline).text(path)
