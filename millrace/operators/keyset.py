"""Dense ids for keys in first-seen order, once or continued."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: New keys from which numbering goes by buckets of the order instead of one sort.
BUCKETS = 128


def keyset(df: DataFrame, key: str, order: str, start: int = 0) -> DataFrame:
    """(id, key): ids from start, in the order of each key's first `order` value (ties by key).

    The keys are cut into ranges of first sight by the values of a bounded sample;
    ids are the count of the ranges before plus a row number within the range, so no
    single task sorts all keys unless they share one first value."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(order).alias("first"))
    some = firsts.filter("first IS NOT NULL").select("first").orderBy(F.xxhash64("key")).limit(10 * BUCKETS).collect()  # bounded
    values = sorted(r[0] for r in some)
    bounds = sorted(set(values[len(values) * i // BUCKETS] for i in range(1, BUCKETS))) if values else []
    kind = firsts.schema["first"].dataType
    bucket = F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in bounds)), lambda b: b < F.col("first"))) if bounds else F.lit(0)
    firsts = firsts.withColumn("b", F.when(F.col("first").isNull(), F.lit(-1)).otherwise(bucket))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = firsts.groupBy("b").count().select("b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("b").orderBy("first", "key"))
    return firsts.withColumn("n", number).join(F.broadcast(counts), "b").select((F.col("before") + F.col("n") - 1 + start).cast("long").alias("id"), "key")


def extend(known: DataFrame, df: DataFrame, key: str, order: str) -> DataFrame:
    """The keyset (id, key) with new keys numbered after its largest id."""
    top = known.agg(F.max("id")).first()[0]
    new = df.join(known.select(F.col("key").alias(key)), key, "left_anti")
    return known.select("id", "key").unionByName(keyset(new, key, order, 0 if top is None else top + 1))


def encode(df: DataFrame, key: str, ids: DataFrame, name: str | None = None) -> DataFrame:
    """df with a key column replaced by its id."""
    name = name or f"{key}_id"
    return df.join(ids.select(F.col("key").alias(key), F.col("id").alias(name)), key, "left").drop(key)
