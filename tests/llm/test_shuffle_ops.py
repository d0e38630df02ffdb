"""Packing, sharding and mixing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import by

from pyspark.sql import functions as F

from millrace.llm import mixing, packing, sharding
from millrace.llm.common import unit

TOK = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("window", [64, 4096])
def test_pack_round_trip(spark, window):
    from tokenizers import Tokenizer

    docs = docs_of(spark)
    pieces = packing.pack(docs, TOK, window=window).collect()
    tok, texts = Tokenizer.from_file(TOK), {r.doc_id: r.text for r in docs.collect()}
    ids = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(ids[p.doc_id]) and p.length == len(p.ids)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
        ids[p.doc_id] += p.ids
    assert {k: v for k, v in ids.items()} == {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    for s, parts in seqs.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == window or s == max(seqs)


def test_word_ids_equal_the_tokenizer():
    import random

    w = packing.WordIds(TOK)
    assert w.short
    r = random.Random(1)
    alphabet = "aAbé́ÉñßüÜ'st.,!?|*#<>-_ \n\t\r\x0b\x0c 　İΣσ中文😀019\x00\x1c\x85"
    for _ in range(400):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(40))) + r.choice(["", " <|endoftext|> x", "don't it's A<|ENDOFTEXT|>b"])
        got = np.frombuffer(w([t], b"\x02\x00")[0], "<u2").tolist()
        assert got == w.tok.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_pack_does_not_depend_on_the_cache(spark):
    docs = docs_of(spark)
    packing.drop_cache()
    few = packing.pack(docs, TOK, cache_words=10).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, packing.pack(docs, TOK).collect()))


def test_word_ids_survive_a_tokenizer_without_piece_ends():
    w = packing.WordIds(TOK)
    w.last[:] = False  # no id ends a piece: every one is encoded by itself
    got = np.frombuffer(w(["some plain words, and more"], b"\x02\x00")[0], "<u2").tolist()
    assert got == w.tok.encode("some plain words, and more", add_special_tokens=False).ids + [2]


def test_word_ids_take_objects_for_distinct_words_only():
    import tracemalloc

    w, text = packing.WordIds(TOK), " ".join(f"w{chr(97 + k % 20)}{chr(97 + k % 13)}," for k in range(600_000))
    tracemalloc.start()
    got = w([text], b"\x02\x00")[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24_000_000, peak  # with an object for each word 87 MB
    assert np.frombuffer(got[-2002:], "<u2").tolist()[-9:] == w.tok.encode(text[-20:], add_special_tokens=False).ids[-8:] + [2]


def test_word_ids_encode_a_word_once_whatever_marks_follow():
    class Counted:
        def __init__(self, tok):
            self.tok, self.pieces = tok, 0

        def encode_batch_fast(self, texts, **kw):
            self.pieces += sum(len(t.split("\n")) for t in texts)
            return self.tok.encode_batch_fast(texts, **kw)

    w = packing.WordIds(TOK, cache_words=100)
    stems = [f"{chr(97 + k % 8)}on{chr(97 + k // 8)}" for k in range(80)]
    w([" ".join(stems)], b"\x02\x00")
    w.bare = Counted(w.bare)
    text = ", ".join(stems)
    assert np.frombuffer(w([text], b"\x02\x00")[0], "<u2").tolist() == w.tok.encode(text, add_special_tokens=False).ids + [2]
    assert w.bare.pieces == 1  # the comma


def test_word_ids_of_some_texts_at_a_time(monkeypatch):
    import random

    monkeypatch.setattr(packing, "CHUNK_BYTES", 60)
    w, r, ends = packing.WordIds(TOK, cache_words=30), random.Random(2), [".", ",|", "'.", "-!", "\u00e9;", "\u00d7.", "9#", "\u0301.", "<|endoftext|>.", "<|endoftext|", "'s?", "\u4e2d*"]
    texts = [" " * r.randrange(3) + " ".join(r.choice(["", "a", "Ab", "\u00c9t\u00e9", "1", "'"]) + r.choice(ends) for _ in range(r.randrange(40))) for _ in range(300)]
    got = w([None, "", *texts], b"\x02\x00")
    assert got[:2] == [b"\x02\x00"] * 2
    for t, ids in zip(texts, got[2:], strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == w.tok.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_pack_odd_rows(odd, nothing):
    got = packing.pack(odd, TOK).collect()
    assert sum(p.length for p in got if p.start == 0 and p.doc_tokens == 1) == 5  # null, empty and blank texts: the end alone
    assert sum(1 for p in got if p.doc_id == 8) == 2
    assert packing.pack(nothing, TOK).count() == 0


def test_shard_rows_law(spark):
    docs = docs_of(spark)
    for k in (1, 3, 8):
        got = sharding.shard(docs, shards=k).collect()
        counts = by(got, lambda r: r.shard)
        assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1 and len(got) == docs.count()
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in counts.values())
        whole = {s: len(v) for s, v in by(got, lambda r: r.source).items()}
        for v in counts.values():  # every shard holds each source in proportion, to one row and a boundary
            for s, mine in by(v, lambda r: r.source).items():
                assert abs(len(mine) - whole[s] / k) <= 2
    again = sharding.shard(docs.repartition(5), shards=8).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sharding.shard(docs, shards=8).collect()))


def test_shard_placement_equals_a_plain_sort(spark, monkeypatch):
    """Every row's shard and slot, against one sort of all rows on the driver."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    docs = docs_of(spark)
    got = sharding.shard(docs, shards=5).collect()
    key = {r.doc_id: r.u for r in spark.createDataFrame([(r.doc_id, r.source, r.size, r.text_crc32) for r in got], "doc_id long, source string, size long, c long").select("doc_id", unit(F.lit(17), "doc_id", "source", "size", "c").alias("u")).collect()}
    order = lambda r: (key[r.doc_id], r.doc_id, r.size, r.text_crc32)
    rank = {r.doc_id: (k + 0.5) / len(v) for v in by(got, lambda r: r.source).values() for k, r in enumerate(sorted(v, key=order))}
    for k, r in enumerate(sorted(got, key=lambda r: (rank[r.doc_id], r.source or "", *order(r)))):
        shard = k * 5 // len(got)
        assert (r.shard, r.slot) == (shard, k - -(-shard * len(got) // 5)), r


def test_queries_equal_their_sql(spark):
    import duckdb

    from millrace.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("mixing_targets", "quality_counts", "shard_sizes"):
        got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        at = [want.columns.index(c) for c in cols]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall()), name


def test_shard_hot_source_and_odd_rows(spark, odd, nothing):
    hot = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    counts = by(sharding.shard(hot).collect(), lambda r: r.shard)
    assert {len(v) for v in counts.values()} == {375}
    assert all(abs(sum(r.source == "hot" for r in v) - 125) <= 1 for v in counts.values())
    rows = sharding.shard(odd, shards=2).collect()
    assert len(rows) == 13 and {r.size for r in rows if r.doc_id == 1} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert sharding.shard(nothing).count() == 0


def water(sizes, weights, total, most=3.0):
    """Brute force: cap and share again until no target is above its cap."""
    capped, target = set(), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in free)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / w for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(docs):
    got = mixing.mix(docs).collect()
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(r.size for r in got if r.source == s) for s in sources}
    want = water(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}, sum(sizes.values()))
    for s in sources:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) + 1e-6
        assert all(r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size for r in mine)
    return got


def test_mix_targets(spark, odd, nothing):
    docs = docs_of(spark)
    got = check_mix(docs)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert len(check_mix(odd)) == 13
    assert mixing.mix(nothing).count() == 0


def test_mix_many_rows_and_a_hot_source(spark):
    hot = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 17 AS int)) AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 11)) AS source")
    check_mix(hot)
    same = spark.range(2000).selectExpr("cast(null AS long) AS doc_id", "'a b c' AS text", "concat('s', id % 2) AS source")
    check_mix(same)


def test_mix_rounding_is_unbiased(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 5 AS int)) AS text", "concat('s', id % 3) AS source").cache()
    n = [sum(r.taken > 0 for r in mixing.mix(docs, seed=s).filter("source = 's0'").collect()) for s in range(4)]
    assert all(35 <= x <= 65 for x in n)  # a share of one half of 100 rows


def test_mixed_repeats_rows(spark, odd):
    docs = docs_of(spark)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = by(mixing.mixed(docs).collect(), lambda r: r.doc_id)
    assert {k: len(v) for k, v in got.items()} == want
    assert mixing.mixed(odd).columns == odd.columns
