"""Removal of long repeated byte strings by a sampled, range-partitioned suffix sort.

Every byte covered by a string of `length` bytes that also starts anywhere else
goes. Not every suffix is sorted: of each window of `length` bytes the `lead`-byte
string with the least hash (leftmost on ties) is its anchor. The choice depends
on the window alone, so two equal windows have the same anchor at the same
offset, and comparing the suffixes that start at anchors, to the right and to the
left, finds every repeat. Windows in a row with one anchor form a span.

1. Anchors whose lead string has a hash that occurs once are done; the hash is a
   filter only. Equal spans (128 bits of BLAKE2b) are counted and stand once.
2. All other spans are suffixes to sort by their bytes: splitters from a sample of
   bounded size range-partition them, each bucket is sorted by a multikey sort over
   eight-byte digits, and common prefixes of neighbours tell, for each offset, which
   windows agree to the right; a second sort of the bytes before the anchors tells
   which also agree to the left. Those, and those of a span that occurs twice, are
   repeated. At most `MOST_BUCKETS` buckets are dealt at a time; more suffixes are
   split into ranges first, which are worked through one after the other.
3. Windows that share their right part with a row at a bucket's edge may have their
   like beyond it; they are compared across boundaries by BLAKE2b of their bytes,
   dealt evenly however many share a lead.

Texts that occur twice or more (copies, by SHA-256) and are long enough go as a
whole. Null text is empty: n_bytes 0, the digest of no bytes. Repeated rows are
copies. Extra columns are ignored, ids may be null, an empty table gives no rows.
Long texts are worked through in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.shingling import U, mix, powers, prefix

LENGTH, LEAD = 200, 40
PIECE = 1 << 19
#: Suffix rows that a bucket of the sort is meant to hold, buckets dealt at a time, sampled rows for each splitter.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 20_000, 4096, 16


def anchors(a: np.ndarray, first: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end in a, each beginning at first[i] (with the end
    last): text number, lead hash, anchor, first and last window."""
    none = np.zeros(0, np.int64)
    n = len(a) - length + 1
    sizes = np.diff(first)
    if n <= 0 or not (sizes >= length).any():
        return none, none.astype(np.uint64), none, none, none
    p = prefix(a)
    _, down = powers(len(a))
    at = np.arange(len(a) - lead + 1)
    h = mix((p[lead:] - p[: len(at)]) * down[: len(at)])
    bits = U(PIECE.bit_length() + 1)
    q = (h >> bits << bits) | at.astype(np.uint64)
    w = length - lead + 1
    fill = np.full(-len(q) % w, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = np.concatenate([q, fill]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & ((U(1) << bits) - U(1))).astype(np.int64)
    inside = np.zeros(n + 1, dtype=np.int32)
    for lo, hi in zip(first, first[1:]):
        if hi - lo >= length:
            inside[lo] += 1
            inside[hi - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    pos = least[start]
    new = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)])
    i1, i2 = start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
    anchor = pos[new]
    return np.searchsorted(first, i1, "right") - 1, h[anchor], anchor, i1, i2


def known(content: bytes, offset: int) -> bytes:
    """What a span or a window is known by: its bytes and where its anchor is."""
    return hashlib.blake2b(content + offset.to_bytes(4, "little"), digest_size=16).digest()


def pieces(raw: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Batches of texts or of overlapping parts of long ones: bytes, bounds, (text, offset)."""
    part, own, n = [], [], 0
    for i, r in enumerate(raw):
        for off in range(0, max(len(r) - length + 1, 1), PIECE - length + 1):
            x = r[off : off + PIECE]
            if n and n + len(x) > PIECE:
                yield np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(y) for y in part]), own
                part, own, n = [], [], 0
            part.append(x)
            own.append((i, off))
            n += len(x)
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(y) for y in part]), own


SPAN = "lead:bigint,span:binary,p:bigint,i1:bigint,i2:bigint"


def scanned(docs: DataFrame, length: int, lead: int) -> DataFrame:
    """tid, doc_id, tx, n_bytes, sha, text, spans; text and spans are null for a copy of a text that the task has had."""
    fields = [("lead", pa.int64()), ("span", pa.binary()), ("p", pa.int64()), ("i1", pa.int64()), ("i2", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
                sha = [hashlib.sha256(r) for r in raw]
                tx = [s.digest()[:16] for s in sha]
                new = []
                for i, x in enumerate(tx):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if len(seen) > 1_000_000:
                    seen = set()
                got: list[list] = [[] for _ in raw]
                for a, first, own in pieces([raw[i] for i in new], length):
                    doc, *cols = anchors(a, first, length, lead)
                    cuts = np.searchsorted(doc, np.arange(len(own) + 1))
                    for k, (j, off) in enumerate(own):
                        s = slice(cuts[k], cuts[k + 1])
                        shift, text = off - first[k], raw[new[j]]
                        p, i1, i2 = (c[s] + shift for c in cols[1:])
                        span = [known(text[x : y + length], z - x) for x, y, z in zip(i1.tolist(), i2.tolist(), p.tolist())]
                        got[new[j]].append((cols[0][s].view(np.int64), span, p, i1, i2))
                cols, sizes = [], [sum(len(x[0]) for x in g) for g in got]
                for k, (_, kind) in enumerate(fields):
                    flat = [x[k] for g in got for x in g]
                    cols.append(pa.array([x for y in flat for x in y] if kind == pa.binary() else np.concatenate(flat) if flat else np.zeros(0, np.int64), type=kind))
                spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), type=pa.int32()), pa.StructArray.from_arrays(cols, names=[f for f, _ in fields]))
                fresh = set(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(tid, tid + len(raw))), batch.column(0), pa.array(tx, type=pa.binary()), pa.array([len(r) for r in raw], type=pa.int64()), pa.array([s.hexdigest() for s in sha]), pa.array([r if i in fresh else None for i, r in enumerate(raw)], type=pa.binary()), spans],
                    ["tid", "doc_id", "tx", "n_bytes", "sha", "text", "spans"],
                )
                tid += len(raw)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"tid long, doc_id {kind}, tx binary, n_bytes long, sha string, text binary, spans array<struct<{SPAN}>>")


def contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(span, n, o, o1, suffix, before): the bytes from the anchor on, and those before it, nearest first, as reversed hexadecimal digits."""
    df = texts.join(wanted, "tid").select("text", "span", "n", "p", "i1", "i2")
    return df.select("span", "n", (F.col("p") - F.col("i1")).alias("o"), (F.col("p") - F.col("i2")).alias("o1"),
                     F.expr(f"substring(text, cast(p + 1 as int), cast(i2 + {length} - p as int))").alias("suffix"), F.reverse(F.hex(F.expr("substring(text, cast(i1 + 1 as int), cast(p - i1 as int))"))).alias("before"))


def multikey(words: np.ndarray) -> np.ndarray:
    """Order of rows by their digits from the left; only rows that still tie are looked at again."""
    order = np.argsort(words[:, 0], kind="stable") if len(words) else np.zeros(0, np.int64)
    group = np.zeros(len(words), dtype=np.int64)
    if len(words):
        k = words[order, 0]
        group = np.cumsum(np.r_[0, (k[1:] != k[:-1])])
    for d in range(1, words.shape[1]):
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((words[rows, d], group[tied]))
        order[tied] = rows[again]
        k = words[order, d]
        same = (group[1:] == group[:-1]) & (k[1:] == k[:-1])
        # rows outside tied groups stay alone
        group = np.cumsum(np.r_[0, ~same])
    return order


def digits(m: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian eight-byte digits."""
    pad = -m.shape[1] % 8
    return np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def laid(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.uint8)
    for i, x in enumerate(rows):
        x = x[:width]
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out


def shared(m: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the next one."""
    differ = m[1:] != m[:-1]
    return np.where(differ.any(1), differ.argmax(1), m.shape[1]) if m.shape[1] else np.zeros(max(len(m) - 1, 0), np.int64)


def repeated(suffix: list[bytes], before: list[bytes], n: np.ndarray, near: np.ndarray, far: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts suffixes and marks repeated windows. near..far: a row's offsets from
    window start to anchor. Returns the order, marks (row x offset, in that order), and
    of each row the longest prefix that it shares with the bucket's first or last row.

    Rows that take part at an offset have all bytes that are compared there, so the
    zeros that fill shorter rows make no two of them equal."""
    w = length - lead + 1
    r, b = laid(suffix, length), laid(before, w)
    order = multikey(np.hstack([digits(r), digits(b)]))
    r, b, n, near, far = r[order], b[order], n[order], near[order], far[order]
    common = shared(r)
    back = multikey(digits(b))
    left = shared(b[back])
    place = np.empty(len(b), dtype=np.int64)
    place[back] = np.arange(len(b))
    marks = np.zeros((len(r), w), dtype=bool)
    for o in range(w):
        on = np.flatnonzero((near <= o) & (o <= far))
        if not len(on):
            continue
        to_right = np.cumsum(np.r_[0, common < length - o])[on]
        to_left = np.cumsum(np.r_[0, left < o])[place[on]]
        _, of, count = np.unique(to_right * len(r) + to_left, return_inverse=True, return_counts=True)
        marks[on, o] = (count[of] > 1) | (n[on] > 1)
    if not len(order):
        return order, marks, np.zeros(0, np.int64)
    to_first = np.minimum.accumulate(np.r_[length, common])
    to_last = np.minimum.accumulate(np.r_[length, common[::-1]])[::-1]
    return order, marks, np.maximum(to_first, to_last)


RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def runs_of(offs: np.ndarray) -> list[dict]:
    """Offsets in order as runs of neighbours."""
    cut = np.flatnonzero(np.diff(offs) != 1) + 1
    return [{"lo": int(x[0]), "hi": int(x[-1])} for x in np.split(offs, cut)]


def key_of(suffix: bytes, before: str, length: int) -> tuple[bytes, bytes]:
    """A row's place in the order, and the bytes before its anchor, nearest first: reversed hexadecimal digits have each byte's digits swapped."""
    near = bytes.fromhex(before[::-1])[::-1]
    return suffix[:length].ljust(length, b"\0") + near, near


def splitters(rows: DataFrame, total: int, parts: int, length: int) -> list[bytes]:
    """At most parts - 1 keys that cut rows into even ranges, from about SAMPLED sampled rows for each: a share of the hashes of spans."""
    if parts < 2:
        return []
    some = rows.filter(F.pmod(F.xxhash64("span"), F.lit(1 << 30)) < int(min(1.0, SAMPLED * parts / total) * (1 << 30))).select("suffix", "before").collect()
    keys = sorted(key_of(bytes(x.suffix), x.before, length)[0] for x in some)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


DEALT = "part long, span binary, n long, o long, o1 long, suffix binary, before binary"


def dealt(rows: DataFrame, cuts: list[bytes], length: int) -> DataFrame:
    """rows with the range between cuts that each falls into."""
    cuts = rows.sparkSession.sparkContext.broadcast(cuts)  # fewer than MOST_BUCKETS keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                keys = [key_of(x, y, length) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
                part = [bisect_right(cuts.value, k) for k, _ in keys]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *b.columns[:5], pa.array([x for _, x in keys], pa.binary())], ["part", "span", "n", "o", "o1", "suffix", "before"])

    return rows.select("span", "n", "o", "o1", "suffix", "before").mapInArrow(run, DEALT)


def sorted_spans(rows: DataFrame, length: int, lead: int) -> DataFrame:
    """(span, runs): the repeated offsets of each span, as runs; a span can have several rows.

    Equal leading bytes are neighbours in the order, so a window can only meet its
    like in another bucket if its row shares the window's right part with a row at
    the bucket's edge. Such windows are compared across boundaries: open ones with
    their owner, settled ones once for all their like, in packed arrays dealt by
    digest."""
    w = length - lead + 1
    total = rows.count()
    ranges = max(1, -(-total // (MOST_BUCKETS * BUCKET_ROWS)))
    rounds = [(rows, total)]
    if ranges > 1:
        cuts = splitters(rows, total, ranges, length)
        at = dealt(rows, cuts, length).select(F.col("part").alias("range"), "span").withColumnRenamed("span", "rs")
        apart = stored(rows.join(at, F.col("span") == F.col("rs")).drop("rs").repartition("range", F.pmod(F.xxhash64("span"), F.lit(64))), by=["range"])
        rounds = [(df, df.count()) for i in range(len(cuts) + 1) for df in [apart.filter(F.col("range") == i).drop("range")]]
    fan = max(1, min(MOST_BUCKETS, -(-total // BUCKET_ROWS)))

    def run(t: pa.Table) -> pa.Table:
        spans, suffix, before = (t.column(c).to_pylist() for c in ("span", "suffix", "before"))
        n, o1, o = (t.column(c).to_numpy() for c in ("n", "o1", "o"))
        order, marks, edge = repeated(suffix, before, n, o1, o, length, lead)
        offset = np.arange(w)
        reach = (o1[order][:, None] <= offset) & (offset <= o[order][:, None]) & (edge[:, None] >= length - offset)
        out: list[tuple] = [(spans[order[i]], runs_of(np.flatnonzero(marks[i])), None, None, None, None) for i in np.flatnonzero(marks.any(1))]
        window = lambda i, k: known(before[order[i]][:k] + suffix[order[i]][: length - k], int(k))
        row, k = np.nonzero(reach & ~marks)
        fps = [window(i, j) for i, j in zip(row.tolist(), k.tolist())]
        settled = {window(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(reach & marks)))}
        by: dict[int, list[tuple[bytes, bytes, int]]] = {}
        for fp, i, j in zip(fps, row.tolist(), k.tolist()):
            by.setdefault(int.from_bytes(fp[:4], "little") % fan, []).append((fp, spans[order[i]], j))
        for fp in settled:
            by.setdefault(int.from_bytes(fp[:4], "little") % fan, []).append((fp, bytes(16), -1))
        for part, some in by.items():
            out.append((None, None, part, *(b"".join(x) for x in list(zip(*some))[:2]), np.array([x[2] for x in some], dtype=np.int32).tobytes()))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.binary(), RUNS, pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(list(x), type=kind) for c, x, kind in zip(("span", "runs", "part", "fps", "spans", "ks"), cols, kinds)})

    def meet(t: pa.Table) -> pa.Table:
        fp, s = (np.frombuffer(b"".join(t.column(c).to_pylist()), "V16") for c in ("fps", "spans"))
        k = np.frombuffer(b"".join(t.column("ks").to_pylist()), np.int32)
        _, of, count = np.unique(fp.view("<u8").reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero((count[of.ravel()] > 1) & (k >= 0))
        got: dict[bytes, list[int]] = {}
        for i in hit.tolist():
            got.setdefault(s[i].tobytes(), []).append(int(k[i]))
        return pa.table({"span": pa.array(list(got), pa.binary()), "runs": pa.array([runs_of(np.sort(x)) for x in got.values()], RUNS)})

    found = None
    for df, size in rounds:
        cuts = splitters(df, max(size, 1), max(1, min(MOST_BUCKETS, -(-size // BUCKET_ROWS))), length)
        got = stored(dealt(df, cuts, length).groupBy("part").applyInArrow(run, "span binary, runs array<struct<lo:int,hi:int>>, part long, fps binary, spans binary, ks binary"))
        found = got if found is None else found.unionByName(got)
    across = found.filter("part IS NOT NULL").select("part", "fps", "spans", "ks").groupBy("part").applyInArrow(meet, "span binary, runs array<struct<lo:int,hi:int>>")
    return found.filter("part IS NULL").select("span", "runs").unionByName(across)


def removed(docs: DataFrame, *, length: int = LENGTH, lead: int = LEAD, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    base = stored(scanned(docs, length, lead))
    spans = base.select("tid", F.inline("spans"))
    leads = spans.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    leads = stored(leads.select(F.col("lead").alias("l")))
    again = stored(spans.join(leads, F.col("lead") == F.col("l"), "left_semi").drop("lead"))

    distinct = again.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "p", "i1", "i2")).alias("at"))
    distinct = stored(distinct.select("span", "n", "at.tid", "at.p", "at.i1", "at.i2"))
    suffixes = stored(contexts(base.filter("text IS NOT NULL").select("tid", "text"), distinct, length))
    found = sorted_spans(suffixes, length, lead)
    found = stored(found.withColumnRenamed("span", "fs"))
    # runs of offsets o become runs of window starts p - o; the last step joins those that overlap
    gone = again.join(found, F.col("span") == F.col("fs")).select("tid", "p", F.explode("runs").alias("r")).select("tid", (F.col("p") - F.col("r.hi")).alias("i1"), (F.col("p") - F.col("r.lo")).alias("i2"))
    gone = stored(gone.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("i1", "i2"))).alias("gone")).withColumnRenamed("tid", "gt"))

    copies = stored(base.groupBy("tx").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("tx").alias("cx")))
    rows = base.select("tid", "doc_id", "tx", "n_bytes", "sha").join(copies, F.col("tx") == F.col("cx"), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    copied = F.col("cx").isNotNull() & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    rows = stored(rows.select("tid", "doc_id", "n_bytes", "sha", copied.alias("copied")))
    cut = base.filter("text IS NOT NULL").select("tid", "text").join(gone, F.col("tid") == F.col("gt")).select("tid", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(lo, 500)
                out = []
                for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    parts, at, n, k, last = [], 0, 0, 0, -1
                    for r in ranges:
                        i, j = r["i1"], r["i2"] + length
                        if i > last:
                            k += 1
                            parts.append(text[max(at, 0) : i])
                            n += j - i
                            last = at = j
                        elif j > last:
                            n += j - last
                            last = at = j
                    parts.append(text[at:])
                    kept = b"".join(parts)
                    out.append((n, k, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["t", "n", "k", "h", "kept"])

    done = cut.mapInArrow(run, "t long, n long, k long, h string, kept binary")
    if not with_kept:
        done = done.drop("kept")
    full = rows.join(done, F.col("tid") == F.col("t"), "left")
    value = lambda c, copied_to, other: F.when(F.col("copied"), F.lit(copied_to)).otherwise(F.coalesce(F.col(c), other))
    got = full.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_removed"),
        value("k", 1, F.lit(0)).cast("long").alias("n_spans"), value("h", empty, F.col("sha")).alias("kept_sha256"),
        *([F.col("kept")] if with_kept else []),
    )
    return got
