"""Line dedup by pairwise alignment.

Texts are split at newlines. Exact copies are settled first: every line of a
later copy goes. Among distinct texts a line is rare if at most `rare_share` of
the texts hold it (two texts at least), and two lines in a row always count as
rare. In the first round each rare unit pairs the earliest text that holds it
with every other one: pairs grow with the lines, not with the square of a group.
Then every line, rare or not, that stays in a later text pairs that text with
the line's earlier holders, the earliest first and four times as many each
round, until it goes or no earlier holder is left. So a worded line goes if
alignment with any earlier text finds it, as if all pairs had been compared;
rarity decides the order of the work, not the result.

Each pair is aligned by patience diff: lines unique to both sides anchor, then
the longest increasing run, extended to equal neighbours. A stretch without such
lines is anchored by lines that come again, the i-th with the i-th. Aligned
blocks go from the later document.

Earlier means the smaller doc_id; null ids come last. Null text has no lines
and stays null. Lines without a word are never units but go as part of a block
of two texts that were compared.
Repeated rows (same id, same text) are one document and are all treated alike.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, worker_turn

#: Share of the texts that may hold a line that still counts as rare.
RARE_SHARE = 0.01


def aligned(a: list, b: list) -> list[int]:
    """Positions in b of the blocks that patience diff aligns with a."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append(blo)
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append(bhi)
        if alo == ahi or blo == bhi:
            continue
        anchors = increasing(once(a, alo, ahi), once(b, blo, bhi)) or increasing(numbered(a, alo, ahi), numbered(b, blo, bhi))
        if not anchors:
            continue
        pa_, pb = alo, blo
        for x, y in [*anchors, (ahi, bhi)]:
            todo.append((pa_, x, pb, y))
            if x < ahi and y < bhi:
                out.append(y)
            pa_, pb = x + 1, y + 1
    return sorted(set(out))


def once(lines: list, lo: int, hi: int) -> dict:
    """Position of each worded line that occurs once in lines[lo:hi]."""
    at: dict = {}
    for i in range(lo, hi):
        at[lines[i]] = -1 if lines[i] in at else i
    return {k: i for k, i in at.items() if i >= 0 and k != 0}


def numbered(lines: list, lo: int, hi: int) -> dict:
    """Position of the i-th occurrence of each worded line in lines[lo:hi]."""
    seen: dict = {}
    at: dict = {}
    for i in range(lo, hi):
        if lines[i] != 0:
            seen[lines[i]] = n = seen.get(lines[i], 0) + 1
            at[lines[i], n] = i
    return at


def increasing(a: dict, b: dict) -> list[tuple[int, int]]:
    """Longest run of common keys whose positions grow on both sides."""
    from bisect import bisect_left

    pairs = sorted((a[k], j) for k, j in b.items() if k in a)
    tails: list[int] = []
    last: list[int] = []
    prev = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            last.append(n)
        else:
            tails[k], last[k] = j, n
        prev[n] = last[k - 1] if k else -1
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = prev[n]
    return out[::-1]


def cuts(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """b, gone: by pair (a, b) the line positions of b that alignment with a finds."""
    both = pairs.join(reps.select(F.col("tx").alias("a"), F.col("h").alias("ha")), "a").select("b", "ha").join(reps.select(F.col("tx").alias("b"), F.col("h").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("linedup")
        for batch in batches:
            gone = [aligned(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, type=pa.list_(pa.int32()))], ["b", "gone"])

    return both.select("b", "ha", "hb").mapInArrow(run, "b string, gone array<int>").filter("size(gone) > 0")


def later_rounds(held: DataFrame, done: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """b, gone of the rounds after the first, whose pairs (a, b) are done. held: u, tx, first, a (the earliest holder) of every shared line.

    Ranks of holders are cut at the round's reach, so no task orders all the holders of a frequent line."""
    spot = lambda df: df.select(F.col("b").alias("tx"), F.explode("gone").alias("p")).distinct()
    later = held.filter("a <> tx").select("tx", "u")
    left = reps.join(later.select("tx").distinct(), "tx", "left_semi").select("tx", F.posexplode("h").alias("p", "u"))
    left = stored(left.join(later, ["tx", "u"], "left_semi").join(spot(found), ["tx", "p"], "left_anti"))
    by_rank = Window.partitionBy("u").orderBy(F.col("first").isNull(), "first", "tx")
    out, reach, further = found.limit(0), 0, 1
    while left.limit(1).count():
        top = held.join(left.select("u").distinct(), "u", "left_semi").select("u", "tx", F.row_number().over(by_rank).alias("r"))
        top = stored(top.filter(F.col("r") <= further))
        left = stored(left.join(top, ["u", "tx"], "left"))
        new = top.filter(F.col("r") > reach).select("u", F.col("tx").alias("a"), F.col("r").alias("ra"))
        pairs = left.select("u", F.col("tx").alias("b"), "r").distinct().join(new, "u").filter("r IS NULL OR ra < r").select("a", "b").distinct()
        pairs = stored(pairs.join(done, ["a", "b"], "left_anti"))
        met = stored(pairs.select(F.explode(F.array("a", "b")).alias("tx")).distinct())
        cut = stored(cuts(pairs, reps.join(met, "tx", "left_semi").select("tx", "h")))
        out, done = out.unionByName(cut), done.unionByName(pairs)
        left = stored(left.filter("r IS NULL").drop("r").join(spot(cut), ["tx", "p"], "left_anti"))
        reach, further = further, 4 * further
    return out


def removals(docs: DataFrame, *, rare_share: float = RARE_SHARE) -> DataFrame:
    """tx, first, gone: by distinct text its earliest document and the line positions to delete from it."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)).otherwise(F.lit(0)))
    texts = docs.filter("text IS NOT NULL").select("doc_id", F.sha2(F.col("text"), 256).alias("tx"), lines.alias("h"))
    # the lines follow from tx; min() with a map-side combine keeps a large group of copies out of one task
    reps = stored(texts.groupBy("tx").agg(F.min("doc_id").alias("first"), F.min("h").alias("h")))
    rare = max(2, int(rare_share * reps.count()))
    order = F.struct(F.col("first").isNull().alias("n"), "first", "tx")
    worded = F.filter("h", lambda x: x != 0)
    held = reps.select("tx", "first", F.inline(F.transform(F.array(worded), lambda w: F.array_distinct(F.concat(
        F.transform(w, lambda x: F.struct(F.lit(1).alias("k"), x.alias("u"))),
        F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.struct(F.lit(2).alias("k"), F.xxhash64(x, y).alias("u"))),
    )))[0]))
    held = stored(held)
    earliest = held.groupBy("k", "u").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    earliest = stored(earliest.filter("n > 1").select("k", "u", "n", F.col("o.tx").alias("a")))
    few = earliest.filter((F.col("k") == 2) | (F.col("n") <= rare)).drop("n")
    pairs = stored(held.join(few, ["k", "u"]).filter("a != tx").select("a", F.col("tx").alias("b")).distinct())
    found = stored(cuts(pairs, reps))
    one = held.filter("k = 1").join(earliest.filter("k = 1").select("u", "a"), "u").select("u", "tx", "first", "a")
    found = found.unionByName(later_rounds(stored(one), pairs, found, reps))
    found = found.groupBy("b").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return reps.select("tx", "first").join(found.withColumnRenamed("b", "tx"), "tx", "left")


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs with text cut, and n_lines and n_removed (columns of these names are replaced)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = stored(removals(docs, **how)).select(F.col("tx").alias("_tx"), F.col("first").alias("_first"), F.col("gone").alias("_gone"))
    df = docs.withColumn("_k", F.sha2(F.col("text"), 256)).join(gone, F.col("_k") == F.col("_tx"), "left")
    df = df.withColumn("_lines", F.split("text", "\n")).withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
    copy = F.coalesce((F.col("doc_id") > F.col("_first")) | (F.col("doc_id").isNull() & F.col("_first").isNotNull()), F.lit(False))
    df = df.withColumn("_copy", copy).withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    df = df.withColumn("n_removed", F.when(F.col("_copy"), F.col("n_lines")).otherwise(F.coalesce(F.size("_gone"), F.lit(0)).cast("long")))
    df = df.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')")
    cut = F.when(F.col("_copy"), F.lit("")).when(F.col("n_removed") == 0, F.col("text")).otherwise(kept)
    return df.withColumn("text", F.when(F.col("text").isNotNull(), cut)).select(*docs.columns, "n_lines", "n_removed")
