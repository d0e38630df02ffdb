"""Exact top-k inner-product search by best-first descent of M-trees.

Components become floor(256 * x). The largest inner product is the smallest
distance once every vector gets one more component sqrt(M^2 - |x|^2), with M
the largest norm of its length's vectors, and the query a zero.

Of equal vectors the k + 1 smallest ids (each as often as it comes, up to k) are
kept from the start: no more can be among a query's best. The others are dealt to
the nearest of at most `PIVOTS` pivots, which farthest-first picks from a bounded
sample; a pivot with many vectors has several trees. So the index is one M-tree
over all: its root's entries are the pivots with their covering radii, and below
each are trees of bounded size, built and stored once, of pages with a pivot, a
covering radius and each entry's distance to its parent's pivot.

A query goes to its nearest pivot first; the k-th best score found there is a
bound, and it goes on only to pivots whose ball comes nearer than that. Inside a
tree the page with the least lower bound is next; stored distances rule entries
out by the triangle inequality before any distance to them is computed. Queries
meet a tree in blocks of bounded size, by an equi-join.

Scores are integer inner products, exact in doubles up to 2**53; beyond that (norms
above 9e7, components above 3e5) they are rounded. Bounds get a slack for rounding,
so no entry that ties is lost.

Vectors that are null, or hold null or non-finite components, and rows without
a vec_id take no part. Only vectors of the query's length are candidates, and
rows with the query's vec_id are its own. Repeated rows count as candidates each.
Of different vectors under one query id, the least in array order is the query.
Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Vectors in a tree, queries in a block, entries in a page, pages under a node, pivots at the root, sampled vectors for each.
TREE, BLOCK, PAGE, FAN, PIVOTS, SAMPLED = 5000, 4000, 128, 8, 512, 16


class Node:
    __slots__ = ("radius", "kids", "rows", "to_parent", "pivots", "radii")


def lifted(v: np.ndarray, m2: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    return np.hstack([v, np.sqrt(np.maximum(m2 - (v * v).sum(1), 0.0))[:, None]])


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE, m2: float | None = None):
        order = np.argsort(ids, kind="stable")
        self.v, self.ids = np.ascontiguousarray(vectors[order]), ids[order]
        norm = (self.v * self.v).sum(1)
        self.m2 = (float(norm.max()) if len(norm) else 0.0) if m2 is None else m2
        self.w = lifted(self.v, self.m2)
        self.page = page
        rows = np.arange(len(ids))
        self.pivot = self.w.mean(0) if len(ids) else np.zeros(self.w.shape[1])
        self.root = self._build(rows, self.pivot)
        del self.w  # the search needs pivots and stored distances only

    def _dist(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.w[rows] - pivot) ** 2).sum(1))

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> Node:
        node = Node()
        d = self._dist(rows, pivot)
        node.radius, node.kids, node.rows = float(d.max()) if len(d) else 0.0, [], None
        if len(rows) <= self.page:
            node.rows, node.to_parent = rows, d
            return node
        # seeds far from each other; a group of equal vectors is cut into equal parts
        seeds, far = [rows[int(d.argmax())]], None
        for _ in range(FAN - 1):
            e = self._dist(rows, self.w[seeds[-1]])
            far = e if far is None else np.minimum(far, e)
            seeds.append(rows[int(far.argmax())])
        near = np.stack([self._dist(rows, self.w[s]) for s in seeds]).argmin(0)
        parts = [rows[near == k] for k in range(FAN)]
        if max(map(len, parts)) > 0.9 * len(rows):
            parts = np.array_split(rows[np.argsort(d, kind="stable")], FAN)
        parts = [p for p in parts if len(p)]
        pivots = [self.w[p].mean(0) for p in parts]
        node.kids = [self._build(p, c) for p, c in zip(parts, pivots)]
        node.pivots, node.radii = np.stack(pivots), np.array([k.radius for k in node.kids])
        node.to_parent = np.sqrt(((node.pivots - pivot) ** 2).sum(1))
        return node

    def search(self, q: np.ndarray, own: int, k: int, least: float | None = None) -> list[tuple[int, int]]:
        """The k best (score, id): higher score first, then smaller id. Below the score `least` nothing is looked for."""
        if not len(self.ids):
            return []
        qq = float(q @ q)
        x = np.r_[q, 0.0]
        slack = 1e-7 * (1.0 + np.sqrt(qq + self.m2))
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        reach = lambda score: np.sqrt(max(0.0, qq + self.m2 - 2.0 * score))
        limit = np.inf if least is None else reach(least)  # distance of the k-th best
        d = float(np.sqrt(((x - self.pivot) ** 2).sum()))
        n, heap = 0, [(max(0.0, d - self.root.radius), 0, d, self.root)]
        while heap:
            bound, _, d, node = heapq.heappop(heap)
            if bound > limit + slack:
                break
            go = np.abs(d - node.to_parent)
            if node.rows is None:
                go = np.flatnonzero(go - node.radii <= limit + slack)
                e = np.sqrt(((node.pivots[go] - x) ** 2).sum(1))
                for i, y in zip(go.tolist(), e.tolist()):
                    low = max(0.0, y - node.kids[i].radius)
                    if low <= limit + slack:
                        n += 1
                        heapq.heappush(heap, (low, n, y, node.kids[i]))
                continue
            rows = node.rows[np.flatnonzero(go <= limit + slack)]
            score = self.v[rows] @ q
            if len(best) == k:
                score, rows = score[(keep := score >= best[0][0])], rows[keep]
            for s, i in zip(score.tolist(), self.ids[rows].tolist()):
                if i != own:
                    item = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def few_of_equal(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors, the k + 1 smallest ids, each at most k times. Both windows are cut before they are shuffled."""
    same = Window.partitionBy("v").orderBy("vec_id")
    got = vectors.withColumn("_id", F.dense_rank().over(same)).filter(F.col("_id") <= k + 1)
    return got.withColumn("_n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("_id"))).filter(F.col("_n") <= k).drop("_id", "_n")


def pivots(vectors: DataFrame, tree: int) -> dict[int, tuple[float, np.ndarray]]:
    """By length of vectors: the largest squared norm, and pivots far from each other among a bounded sample."""
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m2")).collect()
    out = {}
    for r in sizes:
        want = min(PIVOTS, max(1, -(-r.n // tree)))
        some = vectors.filter(F.col("dim") == r.dim).select("v").orderBy(F.xxhash64("vec_id", F.lit(5))).limit(want * SAMPLED).collect()
        x = lifted(np.array([y.v for y in some], dtype=np.float64).reshape(len(some), -1), r.m2)
        at, far = [0], None
        while len(at) < want:
            d = ((x - x[at[-1]]) ** 2).sum(1)
            far = d if far is None else np.minimum(far, d)
            if far.max() <= 0:
                break
            at.append(int(far.argmax()))
        out[r.dim] = (float(r.m2), x[at])
    return out


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, tree: int = TREE, block: int = BLOCK, stats: dict | None = None) -> DataFrame:
    """vectors, queries: (vec_id, v array<double> of integers). query_id, rank, vec_id, score.
    stats, if given, gets how many trees there are, and how many a query visits on average."""
    spark = vectors.sparkSession
    dims = lambda df: df.select("vec_id", "v", F.size("v").alias("dim"))
    vectors, queries = stored(few_of_equal(dims(vectors), k)), stored(dims(queries))
    root = spark.sparkContext.broadcast(pivots(vectors, tree))  # at most PIVOTS vectors of each length

    def near(batches):
        """Nearest pivot of each vector."""
        for b in batches:
            g = np.zeros(b.num_rows, dtype=np.int32)
            dim = b.column(2).to_numpy()
            for d in np.unique(dim).tolist():
                m2, p = root.value[d]
                on = np.flatnonzero(dim == d)
                x = lifted(np.stack([b.column(1)[int(i)].values.to_numpy() for i in on]).reshape(len(on), -1), m2)
                g[on] = (((x * x).sum(1))[:, None] - 2 * x @ p.T + (p * p).sum(1)).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g)], ["vec_id", "v", "dim", "g"])

    dealt = stored(vectors.mapInArrow(near, "vec_id long, v array<double>, dim int, g int"))
    trees_of = dealt.groupBy("dim", "g").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("trees"))
    dealt = dealt.join(F.broadcast(trees_of), ["dim", "g"]).withColumn("s", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("trees")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        dim, g, s = (t.column(c)[0].as_py() for c in ("dim", "g", "s"))
        m2, p = root.value[dim]
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        made = MTree(v, t.column("vec_id").to_numpy(), m2=m2)
        radius = float(np.sqrt(((lifted(v, m2) - p[g]) ** 2).sum(1).max()))
        return pa.table({"dim": pa.array([dim], pa.int32()), "g": pa.array([g], pa.int32()), "s": pa.array([s], pa.int32()), "radius": [radius], "tree": pa.array([pickle.dumps(made)], pa.binary())})

    index = stored(dealt.groupBy("dim", "g", "s").applyInArrow(build, "dim int, g int, s int, radius double, tree binary"))
    balls: dict = {}
    for r in index.groupBy("dim", "g").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("trees")).collect():  # one row a pivot
        balls.setdefault(r.dim, {})[r.g] = (r.radius, r.trees)
    balls = spark.sparkContext.broadcast(balls)

    def routes(first: bool):
        """The trees that each query goes to: one under its nearest ball, or all others that its k-th score leaves in reach."""

        def run(batches):
            for b in batches:
                out = []
                for q, v, dim, least in zip(*(c.to_pylist() for c in b.columns)):
                    if dim not in balls.value:
                        continue
                    m2, p = root.value[dim]
                    at = np.array(sorted(balls.value[dim]))
                    radius = np.array([balls.value[dim][g][0] for g in at.tolist()])
                    qq = float(np.dot(v, v))
                    d = np.sqrt(((p[at] - np.r_[v, 0.0]) ** 2).sum(1))
                    low = np.maximum(0.0, d - radius)
                    home = int(np.lexsort((d, low))[0])
                    one = (int(at[home]), q % balls.value[dim][int(at[home])][1])
                    if first:
                        out.append((q, v, dim, None, *one))
                        continue
                    limit = np.inf if least is None else np.sqrt(max(0.0, qq + m2 - 2.0 * least)) + 1e-7 * (1.0 + np.sqrt(qq + m2))
                    for g in at[low <= limit].tolist():
                        out += [(q, v, dim, least, g, s) for s in range(balls.value[dim][g][1]) if (g, s) != one]
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, kinds)], ["query_id", "q", "dim", "least", "g", "s"])

        return run

    def best(t: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if t.num_rows and asked.num_rows:
            made = pickle.loads(t.column("tree")[0].as_py())
            for q, v, least in zip(*(asked.column(c).to_pylist() for c in ("query_id", "q", "least"))):
                out += [(q, i, s) for s, i in made.search(np.asarray(v, dtype=np.float64), q, k, least) if least is None or s >= least]
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols)})

    def visited(asked: DataFrame) -> DataFrame:
        """Queries meet their trees in blocks; a tree is sent once for each block that it has."""
        asked = stored(asked)
        if stats is not None:
            stats["visits"] = stats.get("visits", 0) + asked.count()
        blocks = asked.groupBy("dim", "g", "s").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        left = index.select("dim", "g", "s", "tree").join(blocks, ["dim", "g", "s"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked.join(blocks, ["dim", "g", "s"]).withColumn("b", F.pmod(F.xxhash64("query_id", F.lit(4)), F.col("blocks")).cast("int"))
        by = ["dim", "g", "s", "b"]
        return left.select(*by, "tree").groupBy(*by).cogroup(right.select(*by, "query_id", "q", "least").groupBy(*by)).applyInArrow(best, "query_id long, vec_id long, score long")

    kinds = "query_id long, q array<double>, dim int, least long, g int, s int"
    start = stored(visited(queries.select("vec_id", "v", "dim", F.lit(None).cast("long").alias("least")).mapInArrow(routes(True), kinds)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    kth = start.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = visited(queries.join(kth, "vec_id", "left").select("vec_id", "v", "dim", "least").mapInArrow(routes(False), kinds))
    if stats is not None:
        stats |= {"trees": index.count(), "queries": queries.count()}
    return start.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256).cast("double")).alias("v"))


def top_k(embeddings: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    vectors = stored(quantised(embeddings))
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), k=k)
