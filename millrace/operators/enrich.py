"""Cached enrichment: distinct values, what the cache lacks, compute, append, join back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE = "key string, fields map<string,string>, state string, timestamp timestamp"


def valid(now: Column | None = None, days: int | None = None) -> Column:
    """State OK and, with a lifetime, an entry younger than so many days."""
    fine = F.col("state") == "OK"
    if days is not None:
        fine = fine & (F.col("timestamp") > F.coalesce(now, F.current_timestamp()) - F.make_interval(days=F.lit(days)))
    return F.coalesce(fine, F.lit(False))


def cleaned(cache: DataFrame) -> DataFrame:
    """Without entries that are empty or were still in progress."""
    return cache.filter(F.col("fields").isNotNull() & (F.size("fields") > 0) & (F.col("state") != "EMPTY"))


def enrich(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, *, days: int | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with `fields` and `state` of its key, the entries after this run).

    compute turns a DataFrame of distinct keys into (key, fields, state); each
    distinct value is worked on once, and only if no valid entry is at hand."""
    wanted = df.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    stamp = F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp()
    if cache is None:
        entries = compute(wanted).select("key", "fields", "state").withColumn("timestamp", stamp)
    else:
        good = cleaned(cache).filter(valid(now, days))
        fresh = compute(wanted.join(good.select("key"), "key", "left_anti")).select("key", "fields", "state").withColumn("timestamp", stamp)
        entries = good.select("key", "fields", "state", "timestamp").unionByName(fresh)
    return joined(df, key, entries), entries


def joined(df: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    return df.join(entries.select(F.col("key").alias("_key"), "fields", "state"), F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def star(df: DataFrame, key: str, order: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fact table with ids in place of a column's values, and that column's lookup table."""
    from millrace.operators.keyset import encode

    return encode(df, key, ids), ids.select("id", F.col("key").alias(key))
