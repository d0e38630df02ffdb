"""Near-duplicate classes by BagMinHash.

A document is the bag of its five-word shingles. Shingle x with count c owns
Poisson points: for each dyadic interval of weights (0,1], (1,2], (2,4], ... a
process whose rate is the interval's width, each point marked with a weight
level and a signature component; points of levels up to c count. A component's
signature is the earliest of its points over the whole bag, so two bags agree
there with a probability equal to their multiset Jaccard similarity. Points are
made in order of time, only until every component has one: about m ln m points,
however long the document.

Bands of `rows` components make buckets (50 bands of 8: a pair of similarity
0.8 misses all with a chance of 1e-4, one of 0.85 with 2e-7). In each bucket the
document that shares most buckets is the hub, and every other one is verified
against it on the exact bags. The Jaccard distance is a metric, so members whose
distances to the hub differ by more than 1 - threshold cannot be linked; the
others, if they are still in different components, are compared block by block,
first by an estimate (five standard deviations of room), then on the exact bags.
Links are joined into classes by label propagation.

Equal texts are one class from the start; only one of them is hashed and
compared. Texts are known by the first 16 bytes of their SHA-256, so ids may be of
any type, null, or shared by several texts: each row gets the class of its own
text. The class id is the smallest doc_id of the class, null if it has null ids
only. Texts that are null or have no word are classes of their own, under their
own id. Repeated rows share their class. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small, stored, worker_turn
from millrace.llm.components import components
from millrace.llm.shingling import STEPS, U, jaccard, mix, shingles

BANDS, ROWS, THRESHOLD = 50, 8, 0.8
CHUNK_CHARS, CHUNK_DOCS = 400_000, 500
#: Texts that a scan task remembers; beyond that it hashes a text again.
SEEN = 1_000_000
#: Processes of points that are walked at once, and points that a step makes of them.
SLICE, POINTS = 65_536, 8192
#: Documents in a block of a hub's documents, and components of the estimates inside.
BLOCK, SKETCH = 1000, 200


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from the upper 44 bits of hashes."""
    return ((x >> U(20)).astype(np.float64) + 0.5) * 2.0**-44


def rise(part: list[np.ndarray], until: np.ndarray, m: int, sig: np.ndarray) -> None:
    """Lowers sig by the points of a part up to their bag's time; state and time of each process move to its last such point.

    Processes are walked side by side, the fewer are left the more points of each at once."""
    doc, count, width, state, time = part
    wide = bool((width > 1).any())
    for first in range(0, len(doc), SLICE):
        at = np.arange(first, min(first + SLICE, len(doc)))
        own, s, t, end = doc[at] * m, state[at], time[at], until[doc[at]]
        while n := len(at):
            k = max(1, POINTS // n)
            # point j of a process: 44 bits of its hash give the time since point j - 1, 20 its component
            x = mix(s[:, None] + np.arange(1, k + 1, dtype=np.uint64) * STEPS[0])
            when = -np.log(unit(x))
            if wide:
                when /= width[at, None]
            when[:, 0] += t
            if k > 1:
                np.add.accumulate(when, axis=1, out=when)
            on = when <= end[:, None]
            f = np.flatnonzero(on)
            x, hit, of = x.ravel()[f], when.ravel()[f], f // k if k > 1 else f
            place = own[of] + ((x & U(0xFFFFF)) * U(m) >> U(20)).astype(np.int64)
            if wide:
                w, c = width[at[of]], count[at[of]]
                # of (w, 2w], or of (0, 1] where every count fits
                fit = (w == 1) | (w + 1 + (mix(x ^ STEPS[2]) & (w - 1).astype(np.uint64)).astype(np.int64) <= c)
                place, hit = place[fit], hit[fit]
            np.minimum.at(sig, place, hit)
            over, go = np.flatnonzero(~on[:, -1]), np.flatnonzero(on[:, -1])
            n_on = on[over].sum(1) if k > 1 else np.zeros(len(over), dtype=np.int64)
            state[at[over]] = s[over] + n_on.astype(np.uint64) * STEPS[0]
            time[at[over]] = np.where(n_on > 0, when[over, n_on - 1], t[over])
            at, own, s, t, end = at[go], own[go], s[go] + np.array([k], dtype=np.uint64) * STEPS[0], when[go, -1], end[go]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """bags x m earliest point times; a bag without elements has infinities."""
    sig = np.full((len(bags), m), np.inf)
    todo = np.array([i for i, (h, _) in enumerate(bags) if len(h)], dtype=np.int64)
    if not len(todo):
        return sig
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    h, c = np.concatenate([h for h, _ in bags]), np.concatenate([n for _, n in bags])
    pace = m / np.maximum(np.bincount(doc, weights=c, minlength=len(bags)), 1)
    levels = []
    while len(h):  # dyadic intervals: (0, 1], (1, 2], (2, 4], ...
        level = len(levels)
        state = mix(h + U(level * int(STEPS[1]) & 0xFFFFFFFFFFFFFFFF))
        levels.append([doc, c, np.full(len(h), 1 << max(level - 1, 0)), state, np.zeros(len(h))])
        more = c > 1 << level
        h, c, doc = h[more], c[more], doc[more]
    parts = [levels[0]] + ([[np.concatenate(v) for v in zip(*levels[1:])]] if levels[1:] else [])
    reach = np.log(m) + 1.0
    while True:
        for part in parts:
            rise(part, reach * pace, m, sig.reshape(-1))
        todo = todo[~np.isfinite(sig[todo]).all(1)]
        if not len(todo):
            return sig
        short = np.zeros(len(bags), dtype=bool)
        short[todo] = True
        left = [np.flatnonzero(short[part[0]]) for part in parts]
        parts = [[v[i] for v in part] for i, part in zip(left, parts)]
        reach += 1.0


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        key = mix(key * STEPS[3] + bits[:, :, r])
    return mix(key + np.arange(bands, dtype=np.uint64) * STEPS[4]).view(np.int64)


def hashed(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, tx (digest of the text, null without a word), keys (band keys; null for a copy seen in the same task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("neardup")
        seen: set[bytes] = set()
        for whole in batches:
            lo = 0
            texts = [t or "" for t in whole.column(1).to_pylist()]
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or (hi - lo < CHUNK_DOCS and n + len(texts[hi]) <= CHUNK_CHARS)):
                    n += len(texts[hi])
                    hi += 1
                part = texts[lo:hi]
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in part]
                new: dict[bytes, int] = {}
                for i, x in enumerate(digests):
                    if x not in seen:
                        new.setdefault(x, i)
                bags = shingles([part[i] for i in new.values()], words)
                keys = band_keys(signatures(bags, bands * rows), bands, rows)
                rowed = {i: k for i, k, b in zip(new.values(), keys, bags) if len(b[0])}
                worded = {x for x, b in zip(new, bags) if len(b[0])}
                tx = [x if x in worded or x in seen else None for x in digests]  # before seen is emptied
                seen |= worded
                if len(seen) > SEEN:
                    seen = worded
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), pa.array(tx, type=pa.binary()), pa.array([rowed.get(i) for i in range(len(part))], type=pa.list_(pa.int64()))], ["doc_id", "tx", "keys"])
                lo = hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tx binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, sim) of the pairs, on the exact bags."""
    left = pairs.join(texts.select(F.col("tx").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("tx").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("neardup")
        known: dict = {}

        def bag(i, text):
            if i not in known:
                if len(known) > 500:
                    known.clear()
                known[i] = shingles([text], words)[0]
            return known[i]

        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                a, b, ta, tb = (c.to_pylist() for c in batch.columns)
                sims = [jaccard(bag(i, x), bag(j, y)) for i, j, x, y in zip(a, b, ta, tb)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, type=pa.float64())], ["a", "b", "sim"])

    return both.mapInArrow(run, "a binary, b binary, sim double")


def across(held: DataFrame, near: DataFrame, label: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Links (a, b) between components that share a hub.

    Documents of a hub are dealt into blocks of bounded size, and those outside
    the hub's component meet every block. Inside a pair of blocks, candidates come
    in order of estimated similarity, those already joined are passed over, and
    only links that join two components leave: no more than there are documents."""
    far = 1 - threshold + 1e-9
    at = held.select("hub", "rep").distinct().join(near.select(F.col("a").alias("hub"), F.col("b").alias("rep"), (1 - F.col("sim")).alias("d")), ["hub", "rep"], "left")
    at = at.join(label.select(F.col("id").alias("rep"), "label"), "rep", "left").select("hub", "rep", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("label", "rep").alias("label"))
    main = F.max(F.when(F.col("rep") == F.col("hub"), F.col("label"))).alias("main")
    of = at.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), main, F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    at = stored(at.join(stored(of.select("hub", "main", "n")), "hub"))
    sides = at.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ny"), F.ceil(F.count(F.when(F.col("label") != F.col("main"), 1)) / BLOCK).cast("int").alias("nx"))
    at = at.join(stored(sides), "hub").join(texts.select(F.col("tx").alias("rep"), "text"), "rep")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    cols = ["hub", "rep", "d", "label", "text"]
    x = at.filter("label <> main").select(*cols, deal("nx").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"))
    y = at.select(*(F.col(c).alias(f"y_{c}") for c in cols), deal("ny").alias("y_j"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("y_i"))

    def join(left, right):
        import pandas as pd

        worker_turn("neardup")
        out = []
        if len(left) and len(right):
            bx, by = shingles(left["text"].tolist(), words), shingles(right["y_text"].tolist(), words)
            sx, sy = signatures(bx, SKETCH), signatures(by, SKETCH)
            dx, dy, lx, ly = left.d.to_numpy(), right.y_d.to_numpy(), left.label.to_numpy(), right.y_label.to_numpy()
            least = threshold - 5 * (threshold * (1 - threshold) / SKETCH) ** 0.5
            found = []
            for i in range(len(left)):
                fit = np.flatnonzero((ly != lx[i]) & (np.abs(dy - dx[i]) <= far))
                if len(fit):
                    est = (sy[fit] == sx[i]).mean(1)
                    keep = est >= least
                    found += [(-e, i, j) for e, j in zip(est[keep].tolist(), fit[keep].tolist())]
            up: dict = {}

            def root(v):
                while up.get(v, v) != v:
                    v = up[v]
                return v

            for _, i, j in sorted(found):
                a, b = root(lx[i]), root(ly[j])
                if a != b and jaccard(bx[i], by[j]) >= threshold:
                    up[max(a, b)] = min(a, b)
                    out.append((left.rep[i], right.y_rep[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return x.groupBy("hub", "i", "j").cogroup(y.groupBy("y_hub", "y_i", "y_j")).applyInPandas(join, "a binary, b binary")


def digest(text: str = "text") -> "F.Column":
    """What a text is known by; null without a word."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32)))


def labelled(docs: DataFrame, threshold: float, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tx) of every row, and (t, class_id, kept) of every text: the class's smallest doc_id and the text that has it."""
    docs = docs.select("doc_id", "text")
    sig = stored(hashed(docs, bands, rows, words))
    reps = stored(sig.filter("tx IS NOT NULL").groupBy("tx").agg(F.min("doc_id").alias("id"), F.min("keys").alias("keys")))
    held = reps.select(F.col("tx").alias("rep"), F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = stored(held.join(stored(shared), "key"))
    degree = stored(held.groupBy("rep").agg(F.sum("n").alias("degree")))
    ranked = held.join(degree, "rep")
    hubs = stored(ranked.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "rep")).alias("h")).select("key", F.col("h.rep").alias("hub")))
    held = stored(held.join(hubs, "key").select("key", "rep", "hub"))
    wanted = small(degree.select(F.col("rep").alias("w")))
    texts = docs.select(digest().alias("tx"), "text").join(wanted, F.col("tx") == F.col("w"), "left_semi")
    texts = stored(texts.dropDuplicates(["tx"]))
    pairs = held.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    near = stored(verified(pairs, texts, words))
    links = near.filter(F.col("sim") >= threshold).select("a", "b")
    label = components(links)

    rest = stored(across(held, near, label, texts, threshold, words))
    if rest.limit(1).count():
        links = links.unionByName(rest)
        label = components(links)

    of = stored(reps.select("tx", "id").join(label.withColumnRenamed("id", "l"), F.col("tx") == F.col("l"), "left").select("tx", "id", F.coalesce("label", "tx").alias("label")))
    best = of.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "tx")).alias("b"))
    named = of.join(best.select("label", F.col("b.id").alias("class_id"), F.col("b.tx").alias("kept")), "label")
    return sig.select("doc_id", "tx"), named.select(F.col("tx").alias("t"), "class_id", "kept")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row."""
    member, named = labelled(docs, threshold, words, bands, rows)
    member = member.join(named, F.col("tx") == F.col("t"), "left")
    return member.select("doc_id", F.when(F.col("tx").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class: that of its smallest doc_id. Of repeated rows one stays. Rows without a word stay, but for repeated ids."""
    _, named = labelled(docs, threshold, words, bands, rows)
    kept = named.filter("t = kept").select(F.col("t").alias("_t"), F.col("class_id").alias("_id"))
    marked = docs.withColumn("_tx", digest())
    worded = marked.join(kept, (F.col("_tx") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "_tx"])
    bare = marked.filter("_tx IS NULL")
    blank = bare.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(bare.filter("doc_id IS NULL"))
    return worded.unionByName(blank).select(*docs.columns)
