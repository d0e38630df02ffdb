"""Packing by concatenate and cut.

Pass one tokenises every document once, in partition order, and stores its ids
with the running token count of the partition. The partition totals (one number
a partition) are summed on the driver into global offsets. Pass two cuts the
global token stream at multiples of the window; a document that crosses a cut
yields one boundary record on each side.

A document's ids are those of its text followed by one end id; null and empty
texts give the end id alone. Repeated rows are packed once each, extra columns
are ignored, an empty table gives no piece. A document of any length is cut as
often as needed; only the very last window can be short.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, worker_turn

#: Distinct words (without the marks after them) whose ids a Python worker remembers before it drops all but those in use.
CACHE_WORDS = 700_000
#: Bytes of text that are encoded at a time; a longer text is encoded by itself.
CHUNK_BYTES = 8_000_000
_loaded: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of a text, word by word: the tokenizer never joins over white space.

    Arrow lowers, cuts and numbers the words of some texts at a time and cuts
    distinct words before their last marks, where a letter or digit stands: the
    tokenizer's own pattern always cuts there. So only distinct parts become Python
    objects; their ids are put back in place by number.

    A plain part (Latin letters, or marks) is one piece of that pattern; new ones
    go to the tokenizer's model directly, many at a time. Any other goes through the
    whole tokenizer. Both are remembered."""

    MARKS = ".,;:!?|*#$%&"
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[.,;:!?|*#$%&]+")  # the second byte pairs: letters from U+00C0 on

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.most = Tokenizer.from_file(path), cache_words
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces: dict[bytes, bytes] = {b"": b""}
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.Split("\n", "removed")
        self.last = np.zeros(self.tok.get_vocab_size(), dtype=bool)  # whether an id ends a piece
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        for token, i in self.tok.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c).lower())[0][0] for c in range(0xC0, 0x100)}
        self.alnum, self.latin = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.alnum[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
        self.latin[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
        # the short way must agree with the tokenizer on a few words, else it is not taken
        probe = ["abc", "\u00e9t\u00e9,", "\u00d1and\u00fa", "x...", "stra\u00dfe!", "w|", "thtionnd", "na\u00efve;", "a1:", "it's?", "b-,", "**"]
        self.short = bool(suffix)
        self.short = self.short and self._words(pa.array(probe)).to_pylist() == [self._whole(w) for w in probe]
        self.pieces = {b"": b""}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _piecewise(self, new: list[bytes]) -> None:
        texts = [b"\n".join(new[i : i + 2000]).decode() for i in range(0, len(new), 2000)]
        got = self.bare.encode_batch_fast([t if t.isascii() else t.translate(self.letters) for t in texts], add_special_tokens=False)
        for i, e in zip(range(0, len(new), 2000), got):
            ids = np.array(e.ids, dtype=self.kind)
            raw, cuts = ids.tobytes(), [0, *((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()]
            if len(cuts) != len(new[i : i + 2000]) + 1:  # a piece without a last token of its own: each by itself
                self.pieces.update((p, self._whole(p.decode())) for p in new[i : i + 2000])
                continue
            self.pieces.update(zip(new[i : i + 2000], (raw[x:y] for x, y in zip(cuts, cuts[1:]))))

    def _learn(self, parts: list[bytes]) -> None:
        if len(self.pieces) > self.most:  # the words of now go on, and with them the frequent ones
            self.pieces = {p: self.pieces[p] for p in (b"", *parts) if p in self.pieces}
        new = list(filterfalse(self.pieces.__contains__, parts))
        plain = list(filter(self.PLAIN.fullmatch, new)) if self.short else []
        plain.sort(key=bytes.isascii)  # most need no translation
        for k in range(0, len(plain), 20_000):
            self._piecewise(plain[k : k + 20_000])
        if len(plain) < len(new):
            self.pieces.update((p, self._whole(p.decode("utf-8", "replace"))) for p in filterfalse(self.pieces.__contains__, new))

    def _words(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of each of some distinct words."""
        n, raw = len(words), words.buffers()[2] or pa.py_buffer(b"")
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[: n + 1]
        twice = np.repeat(offsets, 2)[1:]  # part 2i: word i up to its marks, part 2i + 1: its marks
        if self.short and raw.size:
            data = np.frombuffer(raw, dtype=np.uint8)
            begin, cut = offsets[:-1], offsets[:-1] + pc.binary_length(pc.ascii_rtrim(words, self.MARKS)).to_numpy()
            before = np.take(data, cut - 1, mode="wrap")
            apart = (cut == begin) | self.alnum[before] | (self.latin[before] & (np.take(data, cut - 2, mode="wrap") == 0xC3))
            twice[1::2] = np.where(apart, cut, offsets[1:])
        parts = pa.Array.from_buffers(pa.binary(), 2 * n, [None, pa.py_buffer(twice), raw]).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct)
        ids = pa.array(map(self.pieces.__getitem__, distinct), type=pa.binary()).take(parts.indices)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.frombuffer(ids.buffers()[1], dtype=np.int32)[: 2 * n + 1 : 2].copy()), ids.buffers()[2]])

    def _some(self, texts: pa.StringArray, end: bytes) -> tuple[np.ndarray, pa.Buffer]:
        """Where the ids of each text (none is null) begin and end, and all ids."""
        lowered, marked = pc.ascii_lower(texts), pc.match_substring(texts, "<|")
        if pc.any(marked).as_py():  # marked tokens are told by their case
            lowered = pc.if_else(marked, texts, lowered)
        words = pc.ascii_split_whitespace(lowered)
        ends = words.offsets.to_numpy()[1:]
        words = words.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._words(words.dictionary), pa.array([end], type=pa.binary())])
        ids = ids.take(pa.array(np.insert(words.indices.to_numpy(), ends, len(ids) - 1)))  # every text is followed by the end
        cuts = np.frombuffer(ids.buffers()[1], dtype=np.int32)[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return cuts, ids.buffers()[2]

    def encode(self, texts: pa.Array, end: bytes) -> Iterator[pa.BinaryArray]:
        """The ids of each text with the end after them, for some rows of texts at a time, in order."""
        texts = texts.cast(pa.string()).fill_null("")
        total = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
            cuts, raw = self._some(texts.slice(lo, hi - lo), end)
            yield pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cuts), raw])
            lo = hi

    def __call__(self, texts: list[str | None], end: bytes) -> list[bytes]:
        raw = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], type=pa.binary())
        return [x for some in self.encode(raw.view(pa.string()), end) for x in some.to_pylist()]


def drop_cache() -> None:
    _loaded.clear()


def word_ids(path: str, cache_words: int = CACHE_WORDS) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path, cache_words)
    return _loaded[path]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, cache_words: int) -> DataFrame:
    """(pid, local_start, doc_id, n, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("packing", drop_cache)
        enc, pid, at = word_ids(tokenizer, cache_words), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.kind).tobytes()
        width = len(end)
        for batch in batches:
            lo = 0
            for ids in enc.encode(batch.column(1), end):
                n = pc.binary_length(ids).to_numpy().astype(np.int64) // width
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), pid, dtype=np.int32)), pa.array(start), batch.column(0).slice(lo, len(ids)), pa.array(n), ids], ["pid", "local_start", "doc_id", "n", "ids"])
                lo += len(ids)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"pid int, local_start long, doc_id {id_type}, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if asked for, the piece's ids. cache_words: distinct
    words that a Python worker remembers; fewer cost time, not results."""
    toks = stored(tokenised(docs, tokenizer, end_id, cache_words))
    totals = sorted((r.pid, r.n) for r in toks.groupBy("pid").agg(F.sum("n").alias("n")).collect())  # a row for each partition
    base, at = {}, 0
    for pid, n in totals:
        base[pid], at = at, at + n
    kind = word_ids(tokenizer).kind
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_turn("cutting")
        for batch in batches:
            pids, starts, ns, raws = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            row, cols, pieces = [], [[] for _ in range(6)], []
            for i, (pid, local, n, raw) in enumerate(zip(pids, starts, ns, raws)):
                ids = np.frombuffer(raw, dtype=kind)
                at = base[pid] + local
                first = 0
                while first < n:
                    seq, off = divmod(at + first, window)
                    length = min(n - first, window - off)
                    bits = ids[first : first + length].astype("<u4")
                    row.append(i)
                    for c, v in zip(cols, (first, length, zlib.crc32(bits.tobytes()), n, seq, off)):
                        c.append(v)
                    if with_ids:
                        pieces.append(bits.astype(np.int32))
                    first += length
            arrays = [batch.column(2).take(pa.array(row, type=pa.int64())), *(pa.array(c, type=pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(pieces, type=pa.list_(pa.int32()))] * with_ids, names)

    longs = ", ".join(f"{c} long" for c in names[1:7])
    return toks.mapInArrow(cut, f"doc_id {id_type}, {longs}" + ", ids array<int>" * with_ids)
