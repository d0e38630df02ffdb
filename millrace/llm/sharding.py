"""Sharding by proportional stratified interleaving.

Rows of a source are ranked in a seeded shuffle, and a row's fractional rank is
(rank + 1/2) / rows of the source. All rows are laid in the order of fractional
rank and cut into equal runs, so each shard holds every source in proportion.
The law is `rows`: shard counts are at most one apart. A shard is filled by rank
within the source alone, so equal texts are not kept together: a group of copies
may hold a third of all rows, and no shard could take it whole under this law.

Ranks come without a global sort: rows fall into buckets of their shuffle key,
bucket counts are summed, and row_number() runs within a bucket only. A hot
source is spread over its buckets. The placement depends on the values of a row
alone, so reruns agree; rows equal in every output column are exchangeable.

Null text: size 1, crc32 of the empty string. A null source is a source of its
own. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, unit

#: Rows that a bucket is meant to hold, and the most buckets; beyond 262 million rows buckets
#: get larger, which the sort within a bucket spills for. The placement does not depend on either.
BUCKET_ROWS, MOST_BUCKETS = 1000, 262_144


def shard(docs: DataFrame, *, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source, fraction."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = stored(rows.withColumn("u", unit(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"), F.col("text_crc32"))))
    total = rows.count()
    n = max(1, min(MOST_BUCKETS, -(-total // BUCKET_ROWS)))
    rows = rows.withColumn("b", F.floor(F.col("u") * n).cast("int"))

    # rank within the source: rows of the buckets before, then row_number within the bucket
    per = rows.groupBy("source", "b").count()
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s"), F.col("b").alias("sb"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("source")).alias("of"))
    order = ["u", "doc_id", "size", "text_crc32"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "b").orderBy(*order)) - 1)
    ranked = ranked.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
    ranked = stored(ranked.select("doc_id", "source", "size", "text_crc32", "u", ((F.col("before") + F.col("rank") + 0.5) / F.col("of")).alias("fraction")))

    # position in the order of fractional rank, in the same two steps
    ranked = ranked.withColumn("b", F.least(F.floor(F.col("fraction") * n), F.lit(n - 1)).cast("int"))
    per = ranked.groupBy("b").count()
    per = per.select(F.col("b").alias("sb"), F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("fraction", "source", *order)) - 1)
    placed = placed.join(per, F.col("b") == F.col("sb")).withColumn("position", F.col("before") + F.col("rank"))
    placed = placed.withColumn("shard", F.expr(f"position * {shards} div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")
