"""Language-model scoring by context-tree weighting over bytes.

Documents are dealt into groups of bounded bytes. A group asks for its distinct
(depth + 1)-byte codes and its distinct words, and tells how often its training
documents hold them; both go to buckets, codes by the `TOP` latest context bytes.

Model: a bucket adds up its codes, weighs the subtrees below depth TOP bottom up
(ctw_core) and hands sums of log probabilities to their parents. The depths above
are weighed on the driver: at most 256**(TOP - 1) contexts by 255 bit prefixes,
whatever the input. Then every bucket knows the weights above it, scores the codes
it was asked for from the nodes of all depths and answers the groups. No node is
left out, only the nodes above the subtrees are broadcast, and subtrees are worked
through `SUBTREES` codes at a time, so a task's memory does not follow a bucket's.
A bucket's requests stay with it between the two passes. Where there are many
groups, counts are added up in a tree of partial sums first, and a bucket's askers
are dealt into slices that each get a copy of the sums.

Base: training counts of words come back to the groups the same way.

Null and empty texts are the end token alone. A null doc_id counts as a training
document (its remainder is not known to be the held-out one). Repeated rows are
counted and scored each. Extra columns are ignored. With no training documents
every byte is uniform, and N = V = 0 in the base score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import ctw_core as ctw
from millrace.llm.common import stored, worker_turn

DEPTH, TOP = 6, 3
#: Coded bytes of a group, of a stored row of documents, and of a counted chunk.
GROUP_BYTES, ROW_BYTES, CHUNK_BYTES = 32_000_000, 1_000_000, 2_000_000
#: Coded bytes that a bucket is meant for, and the fewest and most buckets.
BUCKET_BYTES, BUCKETS = 8_000_000, (64, 4096)
#: Parts that one task adds up, askers that share a copy of a bucket's sums, codes weighed at a time.
FAN_IN, SLICE, SUBTREES = 64, 1024, 200_000
WORDS, CODES = 0, 1
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)
#: Planes of a score: the three upper bytes of its 32-bit float, an error of 2**-16 of it at most.
SCORE_BYTES = 3


def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """Numbers as planes of bytes, the highest first (and only so many): sorted numbers pack well."""
    size = a.dtype.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, size)[:, ::-1].T[: width or size]).tobytes()


def unplaned(b: bytes, kind: type, width: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    got = np.frombuffer(b, np.uint8).reshape(width or size, -1)
    out = np.zeros((got.shape[1], size), dtype=np.uint8)
    out[:, size - len(got) :] = got.T[:, ::-1]
    return out.reshape(-1).view(kind)


def grouped(docs: DataFrame, fold: "F.Column", group_bytes: int) -> DataFrame:
    """g, ids, held, size, n_train, blob: runs of documents of a group, coded and packed; each ends with a newline."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n, base = 0, 0, TaskContext.get().partitionId() << 24
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                ends, rows, part, size = [0], [], [], 0
                for i, x in enumerate(batch.column(1).to_pylist()):
                    part.append(ctw.coded(ctw.tokens(x)))
                    size += len(part[-1])
                    n += len(part[-1])
                    if size >= ROW_BYTES or n >= group_bytes or i + 1 == batch.num_rows:
                        rows.append((base + k, size, pa.compress(b"".join(part), codec="zstd", asbytes=True)))
                        ends.append(i + 1)
                        part, size = [], 0
                        if n >= group_bytes:
                            k, n = k + 1, 0
                held = batch.column(2).to_numpy(zero_copy_only=False)
                listed = lambda c: pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), c)
                train = [int((~held[a:b]).sum()) for a, b in zip(ends, ends[1:])]
                g, sizes, blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, type=pa.int64()), listed(batch.column(0)), listed(batch.column(2)), pa.array(sizes, type=pa.int64()), pa.array(train, type=pa.int64()), pa.array(blobs, type=pa.binary())],
                    ["g", "ids", "held", "size", "n_train", "blob"],
                )

    return docs.select("doc_id", "text", fold.alias("held_out")).mapInArrow(run, f"g long, ids array<{kind}>, held array<boolean>, size long, n_train long, blob binary")


def documents(blob: bytes, size: int) -> list[bytes]:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")[:-1]


ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ROWS_SQL = "kind int, bucket long, g long, keys binary, counts binary"


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema)], schema=schema)


def gather(parts: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(kind, bucket, g, keys, counts): what group g asks for, with its training counts."""
    low = min(TOP, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("lm")
        words: Counter = Counter()
        now, seqs, n = None, {False: [], True: []}, 0
        code, count, held = np.zeros(0, U), np.zeros(0, np.uint32), []

        def chunk() -> None:
            nonlocal seqs, n, code, count, held
            for out, s in seqs.items():
                if s:
                    k, c = np.unique(ctw.grams(s, depth), return_counts=True)
                    held.append((k, np.zeros(len(k), np.uint32) if out else c.astype(np.uint32)))
            seqs, n = {False: [], True: []}, 0
            if sum(len(k) for k, _ in held) > 3_000_000:
                merge()

        def merge() -> None:
            """Adds up sorted arrays range by range, so that copies stay small."""
            nonlocal code, count, held
            runs = [(code, count), *held]
            held = []
            longest = max((k for k, _ in runs), key=len)
            cuts = [np.r_[0, np.searchsorted(k, longest[len(longest) // 8 :: len(longest) // 8 + 1]), len(k)] for k, _ in runs]
            got = [ctw.summed(*(np.concatenate([x[j][c[i] : c[i + 1]] for x, c in zip(runs, cuts)]) for j in (0, 1))) for i in range(len(cuts[0]) - 1)]
            code, count = np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal code, count, words
            chunk()
            merge()
            by: dict[int, list[bytes]] = {}
            for w in words:
                by.setdefault(zlib.crc32(w) % buckets, []).append(w)
            rows = [(WORDS, b, now, b" ".join(ws), planes(np.array([words[w] for w in ws], dtype=np.uint64))) for b, ws in by.items()]
            tree = ((code >> U(8 * (depth + 1 - low))) * MIX >> U(40)) % U(buckets)
            order = np.argsort(tree, kind="stable")
            at = np.searchsorted(tree[order], np.arange(buckets + 1, dtype=U))
            rows += [(CODES, b, now, planes(code[order[lo:hi]]), planes(count[order[lo:hi]].astype(np.uint64))) for b, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
            code, count, words = code[:0], count[:0], Counter()
            for lo in range(0, len(rows), 64):
                yield from arrow(rows[lo : lo + 64], ROWS).to_batches()

        for batch in batches:
            for g, outs, size, blob in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "held", "size", "blob"))):
                if g != now:
                    if now is not None:
                        yield from flush()
                    now = g
                for doc, out in zip(documents(blob, size), outs):
                    tok = doc.split()
                    words.update(dict.fromkeys(tok, 0) if out else tok)
                    seqs[out].append(doc + b"\n")
                    n += len(doc) + 1
                    if n >= CHUNK_BYTES:
                        chunk()
        if now is not None:
            yield from flush()

    return parts.select("g", "held", "size", "blob").mapInArrow(run, ROWS_SQL)


def counts_of(t: pa.Table) -> list[np.ndarray]:
    return [unplaned(x, U).astype(np.int64) for x in t.column("counts").to_pylist()]


def word_sums(t: pa.Table) -> dict[bytes, int]:
    sums: dict[bytes, int] = {}
    for ws, cs in zip(t.column("keys").to_pylist(), counts_of(t)):
        for w, c in zip(ws.split(b" "), cs.tolist()):
            sums[w] = sums.get(w, 0) + c
    return sums


def code_sums(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes = [unplaned(x, U) for x in t.column("keys").to_pylist()]
    return ctw.summed(np.concatenate(codes), np.concatenate(counts_of(t)))


def merged(rows: DataFrame) -> DataFrame:
    """The rows of each bucket added up until no bucket has more than FAN_IN: a tree of partial sums."""

    def add(t: pa.Table) -> pa.Table:
        kind, bucket, g = (t.column(c)[0].as_py() for c in ("kind", "bucket", "g"))
        if kind == WORDS:
            sums = word_sums(t)
            return arrow([(kind, bucket, g, b" ".join(sums), planes(np.fromiter(sums.values(), U, len(sums))))], ROWS)
        code, n = code_sums(t)
        return arrow([(kind, bucket, g, planes(code), planes(n.astype(U)))], ROWS)

    most = rows.groupBy("kind", "bucket").count().agg(F.max("count")).first()[0] or 0
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        rows = stored(rows.withColumn("g", F.pmod(F.xxhash64("g", F.lit(most)), F.lit(most))).groupBy("kind", "bucket", "g").applyInArrow(add, ROWS_SQL))
    return rows


def subtrees(code: np.ndarray, depth: int, low: int) -> Iterator[slice]:
    """Runs of whole subtrees below depth low, of about SUBTREES codes."""
    root = code >> U(8 * (depth + 1 - low))
    first = np.flatnonzero(np.r_[True, root[1:] != root[:-1], True]) if len(code) else np.zeros(1, np.int64)
    lo = 0
    for hi in first[1:].tolist():
        if hi - lo >= SUBTREES or hi == len(code):
            yield slice(lo, hi)
            lo = hi


TOPS_SQL = "part int, codes binary, counts binary, nodes binary, sums binary, n long, v long"
TOPS = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("nodes", pa.binary()), ("sums", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
KEPT_SQL = "kind int, gs array<long>, keys array<binary>, votes array<binary>"
KEPT = pa.schema([("kind", pa.int32()), ("gs", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())), ("votes", pa.list_(pa.binary()))])


def by_latest(t: int, code: np.ndarray, n: np.ndarray, key: np.ndarray, lw: np.ndarray) -> pa.Table:
    """Codes with counts and nodes with sums, of depth t: a row for each latest context byte."""
    shift = U(8 * t) if t else U(63)
    a, b, rows = code >> shift, key >> shift, []
    for p in np.unique(a).tolist():
        i, j = a == U(p), b == U(p)
        rows.append((p, code[i].tobytes(), n[i].tobytes(), key[j].tobytes(), lw[j].tobytes(), 0, 0))
    return arrow(rows, TOPS)


def weighed(rows: pa.Table, depth: int) -> pa.Table:
    """What a bucket tells the depths above its subtrees: of words, their count and number."""
    if rows.column("kind")[0].as_py() == WORDS:
        sums = [c for c in word_sums(rows).values() if c]
        return arrow([(-1, None, None, None, None, sum(sums), len(sums))], TOPS)
    low = min(TOP, depth)
    t = low - 1
    code, n = code_sums(rows)
    code, n = code[n > 0], n[n > 0]
    codes, counts, keys, values = [], [], [], []
    for s in subtrees(code, depth, low):
        levels, _ = ctw.tree(code[s], n[s], depth, low)
        root = levels[0]
        codes.append(ctw.shorter(root.code, low, t))
        counts.append(root.count)
        for k in range(8):
            keys.append(ctw.top_index(ctw.shorter(root.code[root.first[k]], low, t), k).astype(U))
            values.append(root.lw[k])
    if not codes:
        return arrow([], TOPS)
    return by_latest(t, *ctw.summed(np.concatenate(codes), np.concatenate(counts)), *ctw.summed(np.concatenate(keys), np.concatenate(values)))


def top(told: DataFrame, depth: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int, int]:
    """Nodes of the depths above the subtrees (sorted keys, probability of a one, own weight), and the words' count and number."""
    low = min(TOP, depth)
    t = low - 1

    def read(rows) -> tuple:
        code, n, key, lw = (np.concatenate([np.frombuffer(x, kind) for x in c]) for c, kind in zip(rows, (U, np.int64, U, np.float64)))
        return *ctw.summed(code, n), *ctw.summed(key, lw)

    def add(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() < 0:
            return arrow([(-1, None, None, None, None, sum(rows.column("n").to_pylist()), sum(rows.column("v").to_pylist()))], TOPS)
        return by_latest(t, *read(rows.column(c).to_pylist() for c in ("codes", "counts", "nodes", "sums")))

    got = told.groupBy("part").applyInArrow(add, TOPS_SQL).collect()  # at most 257 rows, of 256**(TOP - 2) contexts each
    words = [r for r in got if r.part < 0]
    got = [r for r in got if r.part >= 0]
    tops: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, U), np.zeros(0), np.zeros(0))] * low
    if got:
        code, n, key, lw = read([[bytes(x) for x in c] for c in zip(*((r.codes, r.counts, r.nodes, r.sums) for r in got))])
        for d in range(t, -1, -1):
            level = ctw.Level(code, n)
            own = [ctw.top_index(code[level.first[k]], k).astype(U) for k in range(8)]
            level.weigh([lw[np.searchsorted(key, x)] for x in own])
            key = np.concatenate(own)
            order = np.argsort(key)
            n0, n1, w, lw = (np.concatenate(x)[order] for x in (level.n0, level.n1, level.w, level.lw))
            key = key[order]
            tops[d] = (key, (n1 + 0.5) / (n0 + n1 + 1.0), w)
            if d:
                code, n = ctw.summed(ctw.shorter(code, d, d - 1), n)
                key, lw = ctw.summed(ctw.shorter(key, d, d - 1), lw)
    return tops, sum(r.n for r in words), sum(r.v for r in words)


ANSWERS_SQL = "g long, kind int, keys binary, values binary"
ANSWERS = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


def reply(sums: pa.Table, gs: list[int], keys: list[bytes], depth: int, tops) -> pa.Table:
    """To groups that ask one bucket: training counts of words, log10 probabilities of codes."""
    kind, low = sums.column("kind")[0].as_py(), min(TOP, depth)
    if kind == WORDS:
        words = word_sums(sums)
        return arrow([(g, kind, ws, planes(np.array([words[w] for w in ws.split(b" ")], dtype=U))) for g, ws in zip(gs, keys)], ANSWERS)
    code, n = code_sums(sums)
    score = np.zeros(len(code), np.float32)
    for s in subtrees(code, depth, low):
        levels, up = ctw.tree(code[s], n[s], depth, low)
        score[s] = ctw.mixture(code[s], depth, tops, levels, up)
    return arrow([(g, kind, x, planes(score[np.searchsorted(code, unplaned(x, U))], SCORE_BYTES)) for g, x in zip(gs, keys)], ANSWERS)


def answered(asked: DataFrame, groups: int, depth: int) -> tuple[DataFrame, int, int]:
    """(g, kind, keys, values) for all that groups ask, and the words' count and number."""
    spark = asked.sparkSession
    slices = max(1, -(-groups // SLICE))
    if slices == 1:  # few askers: their requests are a bucket's counts, and stay with it

        def first(rows: pa.Table) -> pa.Table:
            worker_turn("lm")
            told, n = weighed(rows, depth), len(KEPT)
            kept = [rows.column("kind")[0].as_py(), *(rows.column(c).to_pylist() for c in ("g", "keys", "counts"))]
            whole = pa.schema([*TOPS, *(f.with_name(f"k_{f.name}") for f in KEPT)])
            return arrow([*(tuple(r.values()) + (None,) * n for r in told.to_pylist()), (*(None,) * len(TOPS), *kept)], whole)

        both = stored(asked.groupBy("kind", "bucket").applyInArrow(first, TOPS_SQL + ", " + KEPT_SQL.replace("kind", "k_kind").replace("gs", "k_gs").replace("keys", "k_keys").replace("votes", "k_votes")))
        tops, n, v = top(both.filter("part IS NOT NULL").select(*TOPS.names), depth)
        shared = spark.sparkContext.broadcast(tops)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_turn("lm")
            for batch in batches:
                for i in range(batch.num_rows):
                    kind, gs, keys, votes = (c[i].as_py() for c in batch.columns)
                    yield from reply(arrow([(kind, 0, g, k, v) for g, k, v in zip(gs, keys, votes)], ROWS), gs, keys, depth, shared.value).to_batches()

        return both.filter("k_kind IS NOT NULL").select(*(f"k_{c}" for c in KEPT.names)).mapInArrow(again, ANSWERS_SQL), n, v

    asked = stored(asked)
    model = merged(asked)
    tops, n, v = top(model.groupBy("kind", "bucket").applyInArrow(lambda t: weighed(t, depth), TOPS_SQL), depth)
    shared = spark.sparkContext.broadcast(tops)

    def meet(m: pa.Table, a: pa.Table) -> pa.Table:
        worker_turn("lm")
        return reply(m, a.column("g").to_pylist(), a.column("keys").to_pylist(), depth, shared.value) if a.num_rows else arrow([], ANSWERS)

    left = model.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = asked.withColumn("slice", F.pmod(F.xxhash64("g"), F.lit(slices)).cast("int"))
    by = ["kind", "bucket", "slice"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, ANSWERS_SQL), n, v


class Lookup:
    """Scores of codes: by a slot of their hash, or else by search."""

    def __init__(self, code: np.ndarray, score: np.ndarray, bits: int = 22):
        order = np.argsort(code)
        self.code, self.score, self.shift = code[order], score[order], U(64 - bits)
        self.slot = np.zeros(1 << bits, dtype=np.int32)
        self.slot[(self.code * MIX >> self.shift).astype(np.int64)] = np.arange(len(code), dtype=np.int32)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self.slot[(code * MIX >> self.shift).astype(np.int64)]
        miss = np.flatnonzero(self.code[at] != code)
        at[miss] = np.searchsorted(self.code, code[miss])
        return self.score[at]


def score(docs: DataFrame, fold: "F.Column", *, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte. depth: 1 to 7."""
    parts = stored(grouped(docs, fold, group_bytes))
    info = parts.agg(F.countDistinct("g").alias("g"), F.sum("n_train").alias("n"), F.sum("size").alias("size")).first()
    buckets = min(max(BUCKETS[0], (info.size or 0) // bucket_bytes), BUCKETS[1])
    replies, n_words, v_words = answered(gather(parts, depth, buckets), info.g, depth)
    ends = info.n or 0
    n_all, v_all = n_words + ends, v_words + (ends > 0)
    floor = math.log10(n_all + v_all + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_turn("lm")
        count: dict[bytes, int] = {}
        codes, scores = [], []
        for k, keys, values in zip(*(right.column(c).to_pylist() for c in ("kind", "keys", "values"))):
            if k == WORDS:
                count.update(zip(keys.split(b" "), unplaned(values, U).tolist()))
            else:
                codes.append(unplaned(keys, U))
                scores.append(unplaned(values, np.float32, SCORE_BYTES))
        look = Lookup(np.concatenate(codes), np.concatenate(scores)) if codes else None
        out = []

        def told(some: list[bytes]) -> None:
            each = look(ctw.grams([x + b"\n" for x in some], depth)).astype(np.float64)
            first = np.cumsum([0] + [len(x) + 1 for x in some])
            for doc, value in zip(some, np.add.reduceat(each, first[:-1]).tolist()):
                tok = doc.split()
                c = np.fromiter(map(count.__getitem__, tok), dtype=np.int64, count=len(tok))
                base = float(np.log10(c + 1.0).sum()) + math.log10(ends + 1.0) - (len(tok) + 1) * floor
                out.append((len(tok) + 1, int((c > 0).sum()) + (ends > 0), n_all, base, value, len(doc) + 1, -value / math.log10(2) / (len(doc) + 1)))

        for size, blob in zip(left.column("size").to_pylist(), left.column("blob").to_pylist()):
            told(documents(blob, size))
        flat = lambda c: pa.concat_arrays([x.flatten() for x in left.column(c).chunks])
        got = arrow(out, pa.schema(list(zip(names, kinds))))
        return pa.Table.from_arrays([flat("ids"), flat("held"), *got.columns], ["doc_id", "held_out", *names])

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return parts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(run, schema)
