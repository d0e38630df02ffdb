"""Language ID, language model, quality, duplicates and search against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ctw_core as ctw
from millrace.llm import langid, linedup, lm, mtree, neardup, quality, queries, shingling, suffixdup
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- language ID


def test_langid_held_out_accuracy(spark):
    got = queries.op1_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_predictions_equal_plain_loops():
    """Trigrams, word scores, path, language and score of whole texts, by loops over characters."""
    rng = np.random.default_rng(11)
    counts = {x: np.r_[rng.integers(0, 9, 1 << langid.BITS), rng.integers(0, 500, langid.N_SCRIPTS)] for x in ("aa", "bb", "cc")}
    counts["bb"][(1 << langid.BITS) + 2] = 0
    model, (script, lower) = langid.Model(counts), langid.tables()
    r = random.Random(5)
    texts = ["".join(r.choice("abcdeÉßд ж. \n1ελ漢") for _ in range(r.randrange(0, 60))) for _ in range(120)] + [None, "", "7 !"]
    m32 = (1 << 32) - 1

    def bucket(c, one, two):
        g = (c * 2654435761 + one * 2246822519 + two * 3266489917) & m32
        return (((g ^ ((c * 40503 & m32) >> 7)) * 668265263) & m32) >> (32 - langid.BITS)

    for text, (lang, score, spans) in zip(texts, model.predict(texts)):
        chars = [(int(lower[ord(x)]) if script[ord(x)] else 0) for x in text or ""]
        found, i = [], 0
        while i < len(chars):
            if not chars[i]:
                i += 1
                continue
            j = i
            while j < len(chars) and chars[j]:
                j += 1
            found.append((i, j))
            i = j
        if not found:
            assert (lang, score, spans) == ("und", 0.0, [])
            continue
        at = lambda k: chars[k] if 0 <= k < len(chars) else 0
        grams = {k: bucket(at(k), at(k - 1), at(k - 2) if at(k - 1) else 0) for i, j in found for k in range(i, j + 1)}
        s = [[sum(float(model.logp[grams[k], x]) for k in range(i, j + 1)) + float(model.script[script[ord(text[i])], x]) for x in range(3)] for i, j in found]
        best = [(v, [x]) for x, v in enumerate(s[0])]
        for row in s[1:]:
            best = [max(((v - (langid.SWITCH if p[-1] != x else 0) + row[x], [*p, x]) for v, p in best), key=lambda b: b[0]) for x in range(3)]
        value, path = max(best, key=lambda b: b[0])
        mine = [model.langs.index(n) for a, b, n in spans for i, j in found if a <= i < b]
        cost = lambda p: sum(s[t][x] for t, x in enumerate(p)) - langid.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
        assert len(mine) == len(found) and abs(cost(mine) - value) < 1e-3
        letters = [sum(j - i for (i, j), x in zip(found, mine) if x == k) for k in range(3)]
        top = letters.index(max(letters))
        seen = [float(model.seen[grams[k], top]) for i, j in found for k in range(i, j)]
        assert lang == model.langs[top] and abs(score - letters[top] / sum(letters) * sum(seen) / len(seen)) < 1e-5


def test_langid_reads_only_text(spark):
    docs = docs_of(spark)
    model = langid.learn(docs)
    a = langid.identify(docs.select("doc_id", "text"), model).orderBy("doc_id").select("lang_pred", "score").collect()
    b = langid.identify(docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("q").alias("source")), model).orderBy("doc_id").select("lang_pred", "score").collect()
    assert a == b


def test_langid_spans_of_mixed_text_and_scripts(spark):
    r = random.Random(5)
    stems = {"aa": ["bana", "kana", "lana", "mana"], "bb": ["strikt", "plinkt", "grundt", "schrift"], "ru": ["привет", "слово", "дерево", "дом"]}
    text = lambda lang, n: " ".join(r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(stems) * 30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = text("aa", 40) + " " + text("bb", 25) + " " + text("ru", 10)
    got = langid.identify(spark.createDataFrame([(1, mixed), (2, "12 !?"), (3, text("ru", 5).upper())], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s.lang for s in got[0].spans] == ["aa", "bb", "ru"] and got[0].lang_pred == "aa"
    assert mixed[got[0].spans[1].start : got[0].spans[1].end].split()[0][:3] in ("str", "pli", "gru", "sch")
    assert (got[1].lang_pred, got[1].score, got[2].lang_pred) == ("und", 0.0, "ru")


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(size=(rng.integers(1, 30), 3)) * 3
        best = max(itertools.product(range(3), repeat=len(s)), key=lambda p: sum(s[t, k] for t, k in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:]))) if len(s) <= 6 else None
        value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(value(langid.label(s, 4.0)) - value(langid.viterbi(s, 4.0))) < 1e-9
        if best:
            assert abs(value(langid.label(s, 4.0)) - value(best)) < 1e-9


def test_langid_odd_rows(odd, nothing):
    model = langid.learn(odd)
    got = langid.identify(odd, model)
    assert got.columns.count("score") == 1 and got.count() == 13
    assert {r.lang_pred for r in got.filter("text IS NULL OR text RLIKE '^[^a-z]*$'").collect()} == {"und"}
    assert langid.identify(nothing, langid.learn(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(nothing)).collect()} == {"und"}


# --- language model


def brute_ctw(texts, text, depth):
    """Log10 probability of a text's bytes by recursion over the context trees."""
    counts: dict = {}
    for s in texts:
        pad = bytes([10]) * depth + s
        for i in range(depth, len(pad)):
            for d in range(depth + 1):
                for k in range(8):
                    key = (pad[i - d : i], (1 << k) | (pad[i] >> (8 - k)))
                    counts.setdefault(key, [0, 0])[(pad[i] >> (7 - k)) & 1] += 1
    kids: dict = {}
    for c, p in counts:
        if c:
            kids.setdefault((c[1:], p), []).append((c, p))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo: dict = {}

    def lw(key):
        if key not in memo:
            own = kt(*counts[key])
            if len(key[0]) == depth:
                memo[key] = own
            else:
                child = sum(lw(k) for k in kids[key])
                memo[key] = np.logaddexp(own, child) - math.log(2)
        return memo[key]

    total = 0.0
    pad = bytes([10]) * depth + text
    for i in range(depth, len(pad)):
        for k in range(8):
            node = (1 << k) | (pad[i] >> (8 - k))

            def prob(d):
                key = (pad[i - d : i], node)
                a, b = counts[key]
                own = (b + 0.5) / (a + b + 1)
                if d == depth or (pad[i - d - 1 : i], node) not in counts:
                    return own
                w = math.exp(kt(a, b) - math.log(2) - lw(key))
                return w * own + (1 - w) * prob(d + 1)

            p = prob(0) if (b"", node) in counts else 0.5
            total += math.log10(p if (pad[i] >> (7 - k)) & 1 else 1 - p)
    return total


@pytest.mark.parametrize("depth,fan_in,slice_,subtrees", [(3, 64, 1024, 200_000), (5, 2, 2, 7), (1, 2, 3, 1), (2, 64, 1024, 5)])
def test_lm_equals_brute_force(spark, monkeypatch, depth, fan_in, slice_, subtrees):
    for name, value in (("FAN_IN", fan_in), ("SLICE", slice_), ("SUBTREES", subtrees), ("BUCKETS", (3, 5)), ("ROW_BYTES", 60)):
        monkeypatch.setattr(lm, name, value)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["ab", "abc", "Cab", "bca", "x"]) for _ in range(r.randrange(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lm.score(df, queries.fold(7, 2), depth=depth, group_bytes=200).collect()}
    toks = {i: ctw.tokens(t) for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in [*toks[i], None])
    n, v = sum(c.values()), len(c)
    for i, _ in rows:
        x = got[i]
        assert x.held_out == (i not in train) and x.train_tokens == n and x.n_tokens == len(toks[i]) + 1
        assert x.n_known == sum(w in c for w in [*toks[i], None])
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*toks[i], None]), rel_tol=1e-9)
        want = brute_ctw([ctw.coded(toks[j]) for j in train], ctw.coded(toks[i]), depth)
        assert math.isclose(x.score, want, rel_tol=1e-4), (i, x.score, want)


def test_lm_beats_the_word_base_on_held_out_text(spark):
    """In code length per byte, at sf0.1; with one more byte of context at sf0.01 too."""
    for sf, depth in (("0.1", lm.DEPTH), ("0.01", 7)):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        got = [x for x in lm.score(docs, queries.fold(7, 2), depth=depth).collect() if x.held_out]
        assert len({x.doc_id for x in got}) == len(got) > 100
        assert sum(x.score for x in got) > sum(x.base_score for x in got)


def test_lm_is_a_distribution():
    r = random.Random(4)
    seqs = [bytes(r.choice(b"abc \n") for _ in range(50)) for _ in range(20)]
    code, n = np.unique(ctw.grams(seqs, 2), return_counts=True)
    for ctx in (b"ab", b"zz", b"\n\n"):  # the latest byte is the context's first here
        asked = np.array([(ctx[0] << 16) | (ctx[1] << 8) | b for b in range(256)], dtype=np.uint64)
        codes, counts = ctw.summed(np.concatenate([code, asked]), np.concatenate([n, np.zeros(256, np.int64)]))
        levels, up = ctw.tree(codes, counts, 2, 0)
        score = ctw.mixture(codes, 2, [], levels, up)
        assert abs((10 ** score[np.searchsorted(codes, asked)]).sum() - 1) < 1e-9


def test_lm_planes_round_trip():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    assert (lm.unplaned(lm.planes(a), np.uint64) == a).all() and len(lm.unplaned(lm.planes(a[:0]), np.uint64)) == 0
    f = -rng.random(1000).astype(np.float32) * 9
    assert np.allclose(lm.unplaned(lm.planes(f, 3), np.float32, 3), f, rtol=2**-15)


def test_lm_odd_rows(odd, nothing):
    rows = lm.score(odd, queries.fold(7, 2), depth=2).collect()
    assert len(rows) == 13 and all(x.score < 0 and math.isfinite(x.base_score) for x in rows)
    assert {x.n_tokens for x in rows if x.doc_id in (1, 2, 3)} == {1}
    twice = [x for x in rows if x.doc_id == 5]
    assert len({(x.score, x.base_score) for x in twice}) <= 1  # repeated rows score alike
    assert lm.score(nothing, queries.fold(7, 2), depth=2).count() == 0


# --- quality


def test_quality_features_and_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    for d in docs.limit(300).collect():
        t, r = d.text or "", got[d.doc_id]
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (not r.base_failed or not r.kept)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[x.doc_id] for x in labels if x.quality == 1 and not got[x.doc_id].base_failed]
    bad = [got[x.doc_id] for x in labels if x.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97 and sum(r.kept for r in bad) / len(bad) < 0.1


def brute_em(patterns, rules, steps):
    """(pi, log ratios) by plain loops."""
    pi, lr = 0.9, [[-1.4, 0.0, 1.4]] * rules
    for _ in range(steps):
        e = [(v, n, 1 / (1 + math.exp(-(math.log(pi / (1 - pi)) + sum(lr[r][v[r] + 1] for r in range(rules)))))) for v, n in patterns]
        g, b = sum(n * p for _, n, p in e), sum(n * (1 - p) for _, n, p in e)
        pi = min(0.99, max(0.01, g / (g + b)))
        lr = []
        for r in range(rules):
            row = []
            for k in (-1, 0, 1):
                x = math.log((sum(n * p for v, n, p in e if v[r] == k) + 0.5) / (g + 1.5)) - math.log((sum(n * (1 - p) for v, n, p in e if v[r] == k) + 0.5) / (b + 1.5))
                row.append(min(0, x) if k < 0 else max(0, x) if k > 0 else x)
            lr.append(row)
    return pi, lr


def test_quality_em_equals_plain_loops(spark):
    patterns = [([1, 0, 0], 50.0), ([0, -1, -1], 10.0), ([0, 0, 0], 30.0), ([1, -1, 0], 4.0), ([-1, 0, -1], 7.0)]
    df = spark.createDataFrame([(patterns,)], "patterns array<struct<v:array<int>,n:double>>")
    em = df.select(F.expr(quality.EM.format(steps=6, rules=3)).alias("em")).first().em
    pi, lr = brute_em(patterns, 3, 6)
    assert math.isclose(em.pi, pi, rel_tol=1e-9)
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(em.lr, lr) for a, b in zip(x, y))


def test_quality_odd_rows(odd, nothing):
    got = quality.judge(odd).collect()
    assert len(got) == 13 and all(r.base_failed for r in got if r.doc_id not in (6, 7))
    assert quality.judge(nothing).count() == 0


# --- near duplicates


def brute_classes(texts):
    bags = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        both = sum((bags[a] & bags[b]).values())
        if both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_neardup_equals_brute_force(spark):
    got = {r.doc_id: r.class_id for r in queries.op5_neardup(spark, SF).collect()}
    assert got == brute_classes({r.doc_id: r.text for r in docs_of(spark).collect()})


def test_neardup_chains_and_large_groups(spark):
    r = random.Random(9)
    rows, base = [], [f"w{r.randrange(9999)}" for _ in range(120)]
    for i in range(60):  # a chain: each differs a little from the one before
        base = base[:]
        base[(7 * i) % 120] = f"z{i}"
        rows.append((i, " ".join(base)))
    hub = [f"v{r.randrange(9999)}" for _ in range(200)]
    for i in range(100, 220):  # copies around one text, few of them like each other
        x = hub[:]
        for _ in range(3):
            x[r.randrange(200)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    rows += [(500 + i, rows[0][1]) for i in range(30)]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(dict(rows))


def test_neardup_takes_ids_of_any_type_and_ids_with_two_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [("x", a), ("y", a + " end"), ("y", b), ("z", b), (None, b), (None, "alone"), ("y", b)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, neardup.classes(docs).collect()), key=repr) == sorted([("x", "x"), ("y", "x"), ("y", "y"), ("z", "y"), (None, "y"), (None, None), ("y", "y")], key=repr)
    assert sorted(map(tuple, neardup.one_of_each(docs).collect()), key=repr) == sorted([("x", a), ("y", b), (None, "alone")], key=repr)


def test_neardup_copies_survive_the_reset_of_seen_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SEEN", 2)
    monkeypatch.setattr(neardup, "CHUNK_DOCS", 2)
    rows = [(1, "one text"), (2, "another text"), (3, "a third"), (4, "one text"), (5, " "), (6, "a third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 3}
    assert {r.doc_id for r in neardup.one_of_each(docs).collect()} == {1, 2, 3, 5}


def test_bagminhash_is_unbiased_on_bags():
    rng = np.random.default_rng(1)
    bags = []
    for _ in range(40):
        h = shingling.mix(rng.choice(400, 120, replace=False).astype(np.uint64) + np.uint64(77))
        bags.append((np.sort(h), rng.integers(1, 9, 120)))
    sig = neardup.signatures(bags, 400)
    err = [(sig[i] == sig[j]).mean() - shingling.jaccard(bags[i], bags[j]) for i, j in itertools.combinations(range(40), 2)]
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.03 and np.isfinite(sig).all()


def test_bagminhash_takes_few_steps_for_small_bags_and_high_counts(monkeypatch):
    steps, mix = [], neardup.mix
    monkeypatch.setattr(neardup, "mix", lambda x: steps.append(len(x)) or mix(x))
    bags = shingling.shingles(["one", "two words", "again " * 20_000, "", " ".join(f"w{i}" for i in range(300))])
    sig = neardup.signatures(bags, 400)
    assert len(steps) < 400 and np.isfinite(sig[[0, 1, 2, 4]]).all() and np.isinf(sig[3]).all()
    assert all(np.array_equal(sig[[i]], neardup.signatures([b], 400)) for i, b in enumerate(bags))


def plain_signature(bag, m):
    """Every point of every process, one at a time, until long after all components have one."""
    sig, steps = [np.inf] * m, [int(x) for x in shingling.STEPS]
    mix = lambda x: int(shingling.mix(np.array([x % 2**64], dtype=np.uint64))[0])
    until = m * (np.log(m) + 6) / int(bag[1].sum())
    for h, c in zip(bag[0].tolist(), bag[1].tolist()):
        for level in range(c.bit_length() + 1):
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            if c <= low:
                break
            state, t, j = mix(h + level * steps[1]), 0.0, 1
            while True:
                x = mix(state + j * steps[0])
                t += -np.log(((x >> 20) + 0.5) * 2.0**-44) / width
                if t > until:
                    break
                if low + 1 + mix(x ^ steps[2]) % width <= c:
                    at = (x & 0xFFFFF) * m >> 20
                    sig[at] = min(sig[at], t)
                j += 1
    return sig


@pytest.mark.parametrize("size, points", [(65_536, 8192), (3, 8)])
def test_bagminhash_equals_a_plain_loop(monkeypatch, size, points):
    monkeypatch.setattr(neardup, "SLICE", size, raising=False)
    monkeypatch.setattr(neardup, "POINTS", points, raising=False)
    bags = shingling.shingles(["one", "a b c d e f g", "again " * 900, "a b c d e f " * 30, " ".join(f"w{i % 37}" for i in range(200))])
    assert np.allclose(neardup.signatures(bags, 32), [plain_signature(b, 32) for b in bags], rtol=1e-9)


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(25)]
    got = {x.id: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + i] == 100 for i in range(20))
    assert all(got[a] == got[b] for a, b in links if a != b)


def test_neardup_odd_rows(odd, nothing):
    got = neardup.classes(odd).collect()
    assert len(got) == 13 and {r.class_id for r in got if r.doc_id is None} == {None, 4}  # a null text, and a copy of 4's
    by_id = {r.doc_id: r.class_id for r in got}
    assert by_id[5] == 4 and by_id[7] == 6 and by_id[1] == 1 and by_id[2] == 2 and by_id[3] == 3
    assert neardup.one_of_each(odd).columns == odd.columns
    assert neardup.classes(nothing).count() == 0


# --- repeated byte strings


def brute_repeats(raw, length):
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        out[k] = (len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("length,lead,bucket,most", [(200, 40, 20_000, 4096), (30, 8, 40, 4096), (30, 8, 3, 4096), (30, 8, 20, 5)])
def test_suffixdup_equals_brute_force(spark, monkeypatch, length, lead, bucket, most):
    monkeypatch.setattr(suffixdup, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(suffixdup, "MOST_BUCKETS", most)
    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    texts = {}
    for i in range(120):
        t = "".join(r.choice("abcdefghé ") for _ in range(r.randrange(0, 160)))
        if i % 3 == 0:
            t = t[:50] + passage[r.randrange(9) : 90 - r.randrange(9)] + t[50:]
        texts[i] = t
    texts |= {200: texts[3], 201: texts[3], 202: "x" * 300, 203: "ab" * 150, 204: None, 205: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdup.removed(df, length=length, lead=lead).collect()}
    assert got == brute_repeats({k: (t or "").encode() for k, t in texts.items()}, length)


def test_suffixdup_hashes_are_a_filter_only(spark, monkeypatch):
    """Where all leads share two hashes, bytes still decide."""
    whole = suffixdup.anchors
    monkeypatch.setattr(suffixdup, "anchors", lambda *a: (lambda got: (got[0], got[1] % np.uint64(2), *got[2:]))(whole(*a)))
    r = random.Random(10)
    texts = {i: "".join(r.choice("abcd") for _ in range(120)) for i in range(30)}
    texts |= {100 + i: texts[i][:60] + texts[i + 1][30:110] for i in range(8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdup.removed(df, length=30, lead=8).collect()}
    assert got == brute_repeats({k: t.encode() for k, t in texts.items()}, 30)


def test_suffixdup_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "PIECE", 512)
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, long), (2, long[1000:1800] + "!" + long[3000:3300]), (3, long[400:700])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats({k: t.encode() for k, t in rows}, 200)


def test_suffixdup_kept_bytes_and_odd_rows(odd, nothing):
    got = suffixdup.removed(odd, with_kept=True).collect()
    assert len(got) == 13 and {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}
    assert [bytes(r.kept).decode()[-5:] for r in got if r.doc_id == 7] == [" tail"]
    assert suffixdup.removed(nothing).count() == 0


def test_multikey_sort_orders_rows():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 3, (500, 21)).astype(np.uint8)
    got = suffixdup.multikey(suffixdup.digits(m))
    assert [bytes(x) for x in m[got]] == sorted(bytes(x) for x in m)


# --- line dedup


def test_patience_alignment():
    a, b = list("abcdefg"), list("xbcyefz")
    assert [b[i] for i in linedup.aligned(a, b)] == list("bcef")
    assert linedup.aligned([], list("ab")) == [] and linedup.aligned(list("ab"), list("ab")) == [0, 1]
    assert linedup.aligned([1, 1, 1, 2], [1, 1, 3, 2]) == [0, 1, 3]


def lcs_positions(a, b):
    """Whether b's given positions spell a common subsequence: checked by greedy embedding."""
    it = iter(a)
    return all(any(x == y for y in it) for x in b)


def test_alignment_is_a_common_subsequence_and_finds_repeated_passages():
    r = random.Random(12)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randrange(14))] for _ in range(2))
        got = linedup.aligned(a, b)
        assert got == sorted(set(got)) and lcs_positions(a, [b[i] for i in got])
    assert linedup.aligned([1, 2, 9, 1, 2], [7, 1, 2, 8, 1, 2, 6]) == [1, 2, 4, 5]  # held twice by both


def test_linedup_large_group_and_boilerplate(spark):
    licence = "This line stands in very many texts."
    rows = [(i, f"own line {i}\n{licence}\nanother {i * 7}") for i in range(200)]
    block = "\n".join(f"shared block line {k}" for k in range(5))
    rows += [(1000 + i, f"head {i}\n{block}\nfoot {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (0.0001, 0.5, 1.0):  # what counts as rare decides the order of the work, not the result
        got = {r.doc_id: r for r in linedup.dedup_lines(docs, rare_share=share).collect()}
        assert got[0].n_removed == 0 and all(got[i].text == f"own line {i}\nanother {i * 7}" for i in range(1, 200))
        assert got[1000].n_removed == 0 and all(got[1000 + i].text == f"head {i}\nfoot {i}" for i in range(1, 150))


def test_linedup_query_equals_true_all_pairs(spark, tmp_path):
    """op10_linededup removes what alignment with any earlier text finds, not only with a line's earliest holder."""
    r = random.Random(7)
    texts = {0: "u\na\nu2", 1: "u2\nb\nu", 2: "u2\nc\nu"}
    for i in range(3, 120):  # few shared lines, so many holders, in any order and often twice
        texts[i] = "\n".join(r.choice([f"own {i} {k}", f"shared {r.randrange(12)}"]) for k in range(r.randrange(2, 9)))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for dir_, docs in ((str(tmp_path), texts), (SF, {x.doc_id: x.text for x in docs_of(spark).collect()})):
        lines, want = {i: t.split("\n") for i, t in docs.items()}, {}
        code = {i: [x if WORD.search(x) else 0 for x in lines[i]] for i in docs}
        for i, t in docs.items():
            gone = {k for j in docs if j < i and set(code[j]) & set(code[i]) - {0} for k in linedup.aligned(code[j], code[i])}
            if any(docs[j] == t for j in docs if j < i):
                want[i] = (len(lines[i]), hashlib.sha256(b"").hexdigest())
                continue
            kept = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
            want[i] = (len(gone), hashlib.sha256(kept.encode()).hexdigest())
        got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in queries.op10_linededup(spark, dir_).collect()}
        assert got == want


def test_linedup_odd_rows(odd, nothing):
    got = linedup.dedup_lines(odd)
    assert sorted(set(got.columns)) == sorted(got.columns) and got.count() == 13
    by_id = {r.doc_id: r for r in got.filter("doc_id IS NOT NULL").collect()}
    assert by_id[5].text == "" and by_id[4].text == "one" and by_id[1].text is None and by_id[1].n_lines == 0
    assert linedup.dedup_lines(nothing).count() == 0


# --- search


def test_topk_equals_brute_force(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op9_topk"]).fetchall()
    assert sorted(map(tuple, queries.op9_topk(spark, SF).collect())) == sorted(want)


def test_topk_groups_blocks_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(400)] + [(1000 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = mtree.search(v, v.filter("vec_id % 10 = 0"), k=5, tree=60, block=7).collect()
    for q, x in rows:
        if q % 10 == 0:
            best = sorted(((-int(np.dot(x, y)), i) for i, y in rows if i != q))[:5]
            assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]


def test_mtree_skips_pages():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 50
    v = np.rint(np.vstack([c + rng.normal(size=(200, 8)) for c in centres]))
    t, looked = mtree.MTree(v, np.arange(len(v)), page=50), []
    whole = t.v
    t.v = type("Counted", (), {"__getitem__": lambda self, i: looked.append(len(i)) or whole[i]})()
    got = t.search(v[7], 7, 5)
    s = v @ v[7]
    assert got == [(int(s[i]), i) for i in sorted((i for i in range(len(v)) if i != 7), key=lambda i: (-s[i], i))[:5]]
    assert sum(looked) < len(v) / 2


def test_topk_passes_over_far_trees(spark):
    """On vectors in clusters a query visits few trees, and the result is exact."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(24, 12)) * 900
    v = np.rint(np.vstack([c + rng.normal(size=(60, 12)) * 9 for c in centres]))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    stats: dict = {}
    got = mtree.search(df, df.filter("vec_id % 20 = 0"), k=3, tree=60, stats=stats).collect()
    for q in range(0, len(v), 20):
        s = v @ v[q]
        best = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-s[i], i))[:3]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, int(s[i])) for i in best]
    assert stats["trees"] > 10 and stats["visits"] < stats["queries"] * stats["trees"] / 2


def test_topk_repeated_ids(spark):
    """Whatever the order of rows, one query id with several vectors means the least of them; repeated rows count each."""
    rows = [(50, [2.0, 1.0]), (50, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])] + [(60 + i, [0.0, 1.0]) for i in range(9)]
    got = [sorted(map(tuple, mtree.top_k(spark.createDataFrame([(*y, 0.5, 7) for y in x], "vec_id long, embedding array<float>, score double, rank int").coalesce(1), k=4).collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1] == [(50, 1, 2, 131072), (50, 2, 2, 131072), (50, 3, 3, 131072), (50, 4, 60, 131072)]


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (50, [1.0, 1.0])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 50), (0, 50), (0, 6), (50, 0), (50, 6)]
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
