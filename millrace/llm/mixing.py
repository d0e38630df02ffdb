"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, capped at `most` times
its own words; the excess is shared again by weight until no target is above
its cap. A document of the source is to be taken target / source words times:
the whole part always, the fraction by the pivotal method. Documents of a
source are dealt into chunks; a chunk folds over its documents, each step
moving words between the fraction carried along and the next one until one of
the two is 0 or 1, in either direction with the odds that keep both
expectations. What a chunk has left is one fraction, which goes to the next
level of the reduction tree; the last one is rounded by itself. So the words
taken differ from the target by less than one document a source.

All draws are hashes of the row's own values: reruns agree, whatever the
partitioning. Identical rows (doc_id, source, size) are told apart by a number.
Null text counts as no words, a null source is a source of its own and the last
one; documents without words are never drawn. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, small, stored

#: Documents in a chunk, on average.
CHUNK = 256
#: Identical rows that are numbered at a time.
SAME = 10_000

#: One step: acc.c is the fraction carried (none or one), acc.out what is decided.
FOLD = """
aggregate(
  items,
  named_struct('c', slice(items, 1, 0), 'out', slice(items, 1, 0)),
  (acc, e) -> CASE
    WHEN e.p <= 0 OR e.p >= 1 THEN named_struct('c', acc.c, 'out', concat(acc.out, array(e)))
    WHEN size(acc.c) = 0 THEN named_struct('c', array(e), 'out', acc.out)
    ELSE transform(
      transform(
        transform(array(acc.c[0]), c -> named_struct(
          'c', c,
          't1', least(c.size * c.p, e.size * (1 - e.p)),
          't2', least(e.size * e.p, c.size * (1 - c.p)))),
        t -> IF(e.u * (t.t1 + t.t2) < t.t2,
          named_struct('p', t.c.p - t.t1 / t.c.size, 'q', e.p + t.t1 / e.size, 'c', t.c),
          named_struct('p', t.c.p + t.t2 / t.c.size, 'q', e.p - t.t2 / e.size, 'c', t.c))),
      t -> transform(
        array(array(
          named_struct('h', t.c.h, 'u', t.c.u, 'doc_id', t.c.doc_id, 'idx', t.c.idx, 'size', t.c.size, 'p', CASE WHEN t.p < 1e-9 THEN 0D WHEN t.p > 1 - 1e-9 THEN 1D ELSE t.p END),
          named_struct('h', e.h, 'u', e.u, 'doc_id', e.doc_id, 'idx', e.idx, 'size', e.size, 'p', CASE WHEN t.q < 1e-9 THEN 0D WHEN t.q > 1 - 1e-9 THEN 1D ELSE t.q END))),
        two -> named_struct('c', filter(two, x -> x.p > 0 AND x.p < 1), 'out', concat(acc.out, filter(two, x -> x.p <= 0 OR x.p >= 1))))[0])[0]
  END)
"""


def word_count(text: str = "text") -> "F.Column":
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, n, source_size, target: one row a source, by water filling."""
    src = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    src = src.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.first(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return src.select("source", "n", "source_size", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap")).alias("target"))


def decide(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 29, chunk: int = CHUNK) -> DataFrame:
    """From (doc_id, source, size): doc_id, source, size, idx, source_size,
    target, copies; idx numbers identical rows from 1."""
    rows = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    src = stored(targets(rows.select("doc_id", "source", (F.col("size") * F.col("m")).alias("size")), weights, most))
    largest = rows.groupBy("source").agg(F.sum("m").alias("m")).agg(F.max("m")).first()[0] or 1
    deals = max(1, math.ceil(math.log(max(largest, 2)) / math.log(chunk)))
    src = src.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    src = src.withColumn("whole", F.floor(F.col("r") + 1e-9)).withColumn("p0", F.greatest(F.col("r") - F.col("whole"), F.lit(0.0)))
    sources = small(stored(src.select(F.col("source").alias("s"), "n", "source_size", "target", "whole", F.when(F.col("p0") < 1e-9, 0.0).otherwise(F.col("p0")).alias("p0"))))

    # identical rows are numbered in two steps, so that no array grows with their count
    rows = rows.select("doc_id", "source", "size", "m", F.explode(F.expr(f"sequence(0L, (m - 1) div {SAME}L)")).alias("hi"))
    rows = rows.select("doc_id", "source", "size", F.explode(F.expr(f"sequence(hi * {SAME}L + 1L, least(m, (hi + 1L) * {SAME}L))")).alias("idx"))
    live = rows.filter("size > 0").join(sources, F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "doc_id", "idx", "size", F.col("p0").alias("p"))
    live = live.withColumn("chunks", F.ceil(F.lit(2.0) * F.col("n") / chunk))
    done = rows.filter("size = 0").select("source", "doc_id", "idx", "size", F.lit(0.0).alias("p"))
    for level in range(deals + 2):
        last = level == deals + 1
        h = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "source", "size", "idx")
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.lit(level), "doc_id", "source", "size", "idx"), 11).cast("double") / float(1 << 53)
        item = F.struct(h.alias("h"), u.alias("u"), "doc_id", "idx", "size", "p")
        deal = F.lit(0) if last else F.pmod(h, F.greatest(F.col("chunks"), F.lit(1)))
        groups = live.groupBy("source", "chunks", deal.alias("deal")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        folded = stored(groups.select("source", "chunks", F.expr(FOLD).alias("f")))
        out = folded.select("source", F.inline("f.out")).select("source", "doc_id", "idx", "size", "p")
        done = done.unionByName(out)
        live = folded.select("source", (F.ceil(F.lit(2.0) * F.col("chunks") / chunk)).alias("chunks"), F.inline("f.c")).select("source", "chunks", "doc_id", "idx", "size", "p")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "doc_id", "source", "size", "idx"), 11).cast("double") / float(1 << 53)
    done = done.unionByName(live.select("source", "doc_id", "idx", "size", F.when(u < F.col("p"), 1.0).otherwise(0.0).alias("p")))
    full = done.join(sources, F.col("source").eqNullSafe(F.col("s")))
    return full.select("doc_id", "source", "size", "idx", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    got = decide(docs.select("doc_id", "source", word_count().alias("size")), **how)
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sized = docs.withColumn("_size", word_count())
    got = decide(sized.select("doc_id", "source", F.col("_size").alias("size")), **how).filter("copies > 0")
    got = got.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("idx").alias("_i"), "copies")
    numbered = sized.withColumn("_idx", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.lit(1))))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_idx") == F.col("_i"))
    taken = numbered.join(got, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*docs.columns)
