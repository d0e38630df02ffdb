"""Language identification by script ranges and Viterbi over word scores.

Learning: hashed letter trigrams of each language are counted over a bounded
sample of labelled documents (`sample_docs` for each language, drawn by hash of
the id). Prediction reads the text alone. A word is a run of letters; its score
in a language is the sum of its trigrams' log probabilities. The word's script
narrows the candidates to the languages that write in it. Viterbi with a
switching penalty labels spans; the language with most letters is the answer.
A document whose best single language cannot be beaten by any span (no run of
words gains more than one penalty) needs no dynamic programme: that test is exact.

lang_pred is `und` with score 0 for null texts and texts without a letter, or
if nothing could be learnt. score is the share of letters in spans of the
answer, times the share of their trigrams that were seen in training. A null
doc_id is never learnt from and counts as not held out. Repeated rows are
predicted each by itself, and extra columns are ignored. Ties go to the
language first by code point.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import unit, worker_turn

#: Unicode blocks by script (fixed values of the Unicode standard): first, last, script.
SCRIPTS = [
    (0x41, 0x24F, "Latin"), (0x250, 0x2AF, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"), (0x590, 0x5FF, "Hebrew"),
    (0x600, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xB80, 0xBFF, "Tamil"), (0xE00, 0xE7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x3FFFF, "Han"),
]
BITS = 16
#: Nats that a change of language costs, and the score of a script that a language does not use.
SWITCH, FOREIGN = 14.0, -60.0
#: A language uses a script if so large a share of its letters is in it.
SCRIPT_SHARE = 0.02
CHUNK_CHARS = 1_000_000
_tables: dict[str, np.ndarray] = {}


def drop_cache() -> None:
    _tables.clear()


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(script by code point, 0 for no letter; lower case by code point)."""
    if not _tables:
        names = sorted({s for _, _, s in SCRIPTS})
        script = np.zeros(0x110000, dtype=np.uint8)
        letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
        script[letter] = len(names) + 1  # some other script
        for lo, hi, s in SCRIPTS:
            script[lo : hi + 1][letter[lo : hi + 1]] = names.index(s) + 1
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            if letter[c] and len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
        _tables.update(script=script, lower=lower)
    return _tables["script"], _tables["lower"]


N_SCRIPTS = len({s for _, _, s in SCRIPTS}) + 2


def words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: trigram bucket by position, starts and ends of
    words, the word's script, and each text's first position."""
    script, lower = tables()
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    first = np.cumsum([0] + [len(r) // 4 + 3 for r in raw])
    code = np.frombuffer(b"\0" * 12 + (b"\0" * 12).join(raw) + b"\0" * 12, dtype=np.uint32)
    kind = script[code]
    c = np.where(kind > 0, lower[code], 0)
    one, two = np.r_[np.uint32(0), c[:-1]], np.r_[np.zeros(2, np.uint32), c[:-2]]
    two = np.where(one == 0, 0, two)
    with np.errstate(over="ignore"):
        gram = (c * np.uint32(2654435761) + one * np.uint32(2246822519) + two * np.uint32(3266489917)) ^ (c * np.uint32(40503) >> np.uint32(7))
        gram = ((gram * np.uint32(668265263)) >> np.uint32(32 - BITS)).astype(np.int64)
    edge = np.flatnonzero(np.diff((kind > 0).astype(np.int8)))
    return gram, edge[::2] + 1, edge[1::2] + 1, kind, first + 3


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Best path of languages over word scores s (words x languages)."""
    back, best = np.zeros(s.shape, dtype=np.int16), s[0].copy()
    here = np.arange(s.shape[1])
    for t in range(1, len(s)):
        top = int(best.argmax())
        jump = best[top] - penalty > best
        back[t] = np.where(jump, top, here)
        best = np.where(jump, best[top] - penalty, best) + s[t]
    path = np.empty(len(s), dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(len(s) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(s: np.ndarray, penalty: float) -> np.ndarray:
    """As viterbi(); most documents are settled by one pass over their sums."""
    star = int(s.sum(0).argmax())
    run = np.cumsum(np.vstack([np.zeros(s.shape[1]), s - s[:, star : star + 1]]), axis=0)
    if (run - np.minimum.accumulate(run, axis=0)).max() <= penalty:
        return np.full(len(s), star)
    return viterbi(s, penalty)


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: by language, trigram buckets and then scripts."""
        self.langs = sorted(counts)
        n = np.array([counts[x] for x in self.langs]).reshape(len(self.langs), (1 << BITS) + N_SCRIPTS)
        grams, by_script = n[:, : 1 << BITS], n[:, 1 << BITS :]
        self.seen = (grams > 0).T.astype(np.float32).copy()
        self.logp = np.log((grams + 0.2) / (grams.sum(1, keepdims=True) + 0.2 * (1 << BITS))).T.astype(np.float32).copy()
        share = by_script / np.maximum(by_script.sum(1, keepdims=True), 1)
        self.script = np.where(share >= SCRIPT_SHARE, 0.0, FOREIGN).T.astype(np.float32)
        self.script[(share < SCRIPT_SHARE).all(0)] = 0.0  # a script that no language uses leaves all as candidates

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        got = ["" if t is None else t for t in texts]
        gram, start, end, kind, first = words(got)
        bounds = np.searchsorted(start, first)
        if not self.langs or not len(start):
            return [("und", 0.0, [])] * len(texts)
        # a word's trigrams are those that end in it or at its end
        total = np.add.reduceat(self.logp[gram], np.stack([start, end + 1], 1).ravel())[::2] + self.script[kind[start]]
        size = end - start
        out = []
        for i in range(len(texts)):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if lo == hi:
                out.append(("und", 0.0, []))
                continue
            path, n = label(total[lo:hi], SWITCH), size[lo:hi]
            letters = np.bincount(path, weights=n, minlength=len(self.langs))
            top = int(letters.argmax())
            at = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            base = int(first[i])
            spans = [(int(start[lo + a]) - base, int(end[lo + b - 1]) - base, self.langs[int(path[a])]) for a, b in zip(at, [*at[1:], hi - lo])]
            mine = slice(int(start[lo]), int(end[hi - 1]) + 1)
            inside = kind[mine] > 0
            seen = float(self.seen[gram[mine][inside], top].mean())
            out.append((self.langs[top], min(1.0, float(letters[top] / letters.sum()) * seen), spans))
        return out


def chunks(texts: list, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    lo = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > most:
            yield lo, i
            lo, n = i, 0
        n += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def learn(docs: DataFrame, *, folds: int = 4, held_out: int = 2, sample_docs: int = 3000) -> Model:
    """sample_docs: bound on the documents of a language that are learnt from."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds
    known = docs.filter((fold != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, k in n.items():
        keep = keep | ((F.col("lang") == lang) & (unit(F.lit(5), F.col("doc_id")) < min(1.0, sample_docs / k)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("langid", drop_cache)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), dtype=object), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                own = list(texts[langs == lang])
                for lo, hi in chunks(own):
                    gram, start, end, kind, _ = words(own[lo:hi])
                    letter = (kind > 0) | np.r_[False, kind[:-1] > 0]
                    sums.setdefault(lang, np.zeros((1 << BITS) + N_SCRIPTS, dtype=np.int64))
                    sums[lang][: 1 << BITS] += np.bincount(gram[letter], minlength=1 << BITS)
                    sums[lang][1 << BITS :] += np.bincount(kind[kind > 0], minlength=N_SCRIPTS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), pa.array([x.tobytes() for x in sums.values()], type=pa.binary())], ["lang", "counts"])

    def add(key, part):
        return part.assign(counts=[np.sum([np.frombuffer(x, dtype=np.int64) for x in part.counts], axis=0).tobytes()] * len(part))[:1]

    per = known.filter(keep).select("lang", "text").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary")
    return Model({r.lang: np.frombuffer(bytes(r.counts), dtype=np.int64) for r in per.collect()})  # a row for each language


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """The columns of docs with lang_pred, score and spans (start, end in characters,
    language), under a prefix if given; columns of these names are replaced."""
    made = [prefix + c for c in ("lang_pred", "score", "spans")]
    docs = docs.drop(*made)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), docs.columns
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("langid", drop_cache)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                texts, got = batch.column(at).to_pylist(), []
                for lo, hi in chunks(texts):
                    got += shared.value.predict(texts[lo:hi])
                more = [pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64()), pa.array([[dict(zip(("start", "end", "lang"), s)) for s in g[2]] for g in got], type=span)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *made])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, `{made[0]}` string, `{made[1]}` double, `{made[2]}` array<struct<start:int,end:int,lang:string>>")
