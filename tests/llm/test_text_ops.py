"""N-gram join, suffix dedup, toxicity, quality and the pipeline: brute force and held-out accuracy."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import ngramjoin, quality, suffixes, toxicity, words
from barloom.llm.arrays import WordHashes
from barloom.llm.common import held_out
from barloom.llm.words import LONGEST, coded, grams

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, sid string, marks string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None, "s", len(t or ""), "k", "s", "m") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n", "one", "ONE", "one two three", "one  two\tTHREE", "Ünï 文字 😀 " * 3]


# -- op3


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(5000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent):
    monkeypatch.setattr(ngramjoin, "TILE", 7)  # several tiles a family
    rng = random.Random(n)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*ODD, *family(rng, 25, 120, 8), *family(rng, 25, 60, 3), *family(rng, 10, 12, 1), *family(rng, 10, 400, 14)]
    texts += [f"{passage} " + " ".join(f"q{i}x{k}" for k in range(30)) for i in range(15)]  # one passage, different texts
    texts += [texts[20]] * 5 + [texts[20].upper()]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs(spark, texts), n, percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_pairs_above_the_bound_share_a_block():
    rng, classes, words = random.Random(0), ngramjoin.Classes(85), WordHashes()
    for size in (7, 8, 20, 33, 100, 301):
        for _ in range(60):
            a, b = (ngramjoin.ngram_set(t.encode(), 4, words) for t in family(rng, 2, size + 3, max(1, size // 60)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) + len(b) != 2 * both:
                ka, kb = (set(np.concatenate(classes.keys(x)).tolist()) for x in (a, b))
                assert ka & kb


def test_join_of_nothing_and_without_ids(spark):
    assert ngramjoin.jaccard_components(docs(spark, [])).count() == 0
    got = ngramjoin.jaccard_components(docs(spark, ["a b c d e", "a b c d e", "x"], ids=[None, 4, None])).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "None"]


def test_one_of_each(spark):
    rng = random.Random(2)
    texts = [*family(rng, 12, 100, 1), "alone here", "", "", None]
    d = docs(spark, texts)
    got = ngramjoin.one_of_each(d, 5, 80)
    want = {c for i, (_, c) in brute_components(texts, 5, 80).items()}
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == want
    again = ngramjoin.one_of_each(docs(spark, ["a b", "a b", "c d"], ids=[1, 1, None]))
    assert sorted(str(r.doc_id) for r in again.collect()) == ["1", "None"]
    # Different texts under one id are rows of their own; a copy without an id goes, and of two without one stays.
    more = ngramjoin.one_of_each(docs(spark, ["a b", "c d", "c d", "e f", "e f", ""], ids=[1, 1, None, None, None, None]))
    assert sorted((str(r.doc_id), r.text) for r in more.collect()) == [("1", "a b"), ("1", "c d"), ("None", ""), ("None", "e f")]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_of_a_table_equal_brute_force(spark, sf, n, percent):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    order = sorted(texts)
    want = {order[i]: (size, order[c]) for i, (size, c) in brute_components([texts[i] for i in order], n, percent).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(d, n, percent).collect()} == want


def test_near_misses_in_shared_buckets(spark, monkeypatch):
    """Many texts just under and over the threshold that share blocks: pairs and whole tiles, in several parts."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        w = list(base)
        for i in rng.sample(range(150), rng.choice([2, 4, 5, 6])):
            w[i] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    want = brute_components(texts, 4, 85)
    assert 1 < len({c for _, c in want.values()}) < 90
    kept = {}
    keep_ = ngramjoin.keep
    monkeypatch.setattr(ngramjoin, "forget", lambda *t: None)
    monkeypatch.setattr(ngramjoin, "keep", lambda df, name: kept.setdefault(f"{name}{len(kept)}", keep_(df, name)))
    for tile, most in ((1024, 4), (16, 0)):
        monkeypatch.setattr(ngramjoin, "TILE", tile)
        monkeypatch.setattr(ngramjoin, "DENSE", most)
        kept.clear()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs(spark, texts)).collect()} == want
        got = next(v for k, v in kept.items() if k.startswith("candidates"))
        assert got.count() > 0 and (most > 0 or got.where("a is null").count() > 0 and got.agg(F.max("j")).first()[0] > 0)
        assert most > 0 or any(k.startswith("tiles") and v.count() for k, v in kept.items())


def test_sketches_lose_no_pair():
    rng, words = random.Random(1), WordHashes()
    for size in (5, 40, 300, 2000):
        sets = [ngramjoin.ngram_set(t.encode(), 4, words) for t in family(rng, 12, size, max(1, size // 40))]
        k = min(len(ngramjoin.sketch(s, 85)) for s in sets)
        bits = ngramjoin.folded([ngramjoin.sketch(s, 85) for s in sets], k)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    assert ngramjoin.may_reach(bits[i : i + 1], bits[j : j + 1], np.array([len(a)]), np.array([len(b)]), 85)[0]


# -- op9


def brute_removed(texts, length):
    items = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in items for p in range(len(b) - length + 1))
    out = []
    for b in items:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 64, 16, 100])
def test_refinement_equals_brute_force(length):
    """Buckets of windows, by the sort alone: no hash takes part."""
    rng = random.Random(length)
    a = bytes(rng.choices(b"ab", k=3 * length))
    items = [a, a[: length + 3], b"ab" * length, bytes(rng.choices(b"abc", k=500)) + a[5 : 5 + length], b"\0" * (length + 9), b"\xff" * length, b"short", b"", a[1:]]
    data, starts = np.frombuffer(b"".join(items), np.uint8), np.cumsum([0, *map(len, items)])
    at, bucket = suffixes.repeated_windows(data, starts, length)
    want = [(s + i, x[i : i + length]) for s, x in zip(starts.tolist(), items, strict=False) for i in range(len(x) - length + 1)]
    assert at.tolist() == [p for p, _ in want]
    names: dict[bytes, set] = {}
    for (_, x), k in zip(want, bucket.tolist(), strict=True):
        names.setdefault(x, set()).add(k)
    assert all(len(k) == 1 for k in names.values()) and len(set.union(*names.values())) == len(names)
    assert len(suffixes.repeated_windows(data[:3], np.array([0, 3]), length)[0]) == 0


@pytest.mark.parametrize("chunk", [1 << 18, 700])
def test_removal_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdé") for _ in range(k))
    a, b = word(350), word(230)
    texts = [word(300) + a + word(80), word(20) + a, a[:199] + word(50), a[:200] + "zz", "y" + a[1:201], b + word(5) + b, "Ther " * 120, "x" + "Ther " * 70, "ab" * 150 + word(10), "q" * 199, "q" * 200, "r" * 201, *ODD, word(500), "copy" + b * 2, "copy" + b * 2, ("0123456789" * 13 + "!") * 4]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 200)


def test_large_buckets_are_dealt_over_tasks(spark, monkeypatch):
    """A short passage common to all texts: its windows differ, but for those that some texts share."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdé") for _ in range(k))
    a, tails = word(120), [word(100) for _ in range(40)]
    texts = [word(150) + a + rng.choice(tails) + word(rng.randrange(60)) for _ in range(120)] + [word(260) for _ in range(5)] + ["ab" * 150]
    most, keep = [], suffixes.keep

    def seen(df, name):
        """The table of windows is deleted when it has been read, so it is looked at when it is written."""
        out = keep(df, name)
        if name == "windows":
            w = out.where("`to` is null")
            most.extend(w.groupBy(*by).count().agg(F.max("count")).first()[0] for by in (["key"], ["key", F.expr("pmod(xxhash64(text_id), coalesce(shards, 1))")]))
        return out

    monkeypatch.setattr(suffixes, "keep", seen)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs(spark, texts), big=10).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 200)
    assert most[0] >= 100 and most[1] <= 40


def test_names_are_drawn_again_when_two_texts_share_one(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(suffixes.F, "xxhash64", lambda seed, *c: F.when(seed == 0, F.lit(5).cast("long")).otherwise(real(seed, *c)))
    texts = ["a" * 230, "b" * 230, "a" * 230, "c"]
    got = suffixes._named(docs(spark, texts)).collect()
    assert len({(r.text_id, r.n) for r in got}) == 3
    assert suffixes._named(docs(spark, texts[:1] * 3)).select("text_id").distinct().collect() == [(5,)]


def test_removal_of_nothing(spark):
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0
    assert suffixes.remove_repeats(docs(spark, [None, "", "short"])).agg(F.sum("n_removed")).first()[0] == 0


# -- op2, op5


def test_tokens_are_whole():
    text = "a  b\n" + "z" * (LONGEST - 1) + " é "
    kinds, codes, sizes = coded(pa.array([text, None, "", " ", "b"]))
    assert sizes.tolist() == [4, 0, 0, 0, 1] and len(set(kinds)) == len(kinds)
    assert "".join(kinds[c] for c in codes[:4]) == text.replace(" ", "").replace("\n", "")


def test_long_runs_lose_no_ngram(monkeypatch):
    rng = random.Random(2)
    run = "".join(rng.choice("abcdefgh") for _ in range(3 * LONGEST + 7))
    kinds, codes, sizes = coded(pa.array([run]))
    pieces = [kinds[c] for c in codes]
    assert sizes.tolist() == [len(pieces)] and max(map(len, pieces)) == LONGEST
    for n in (3, 4, 5, 6):
        assert {run[i : i + n] for i in range(len(run) - n + 1)} == {p[i : i + n] for p in pieces for i in range(len(p) - n + 1)}
    whole = words.grams(["ab", "", "x" * 50, *pieces], 16)
    monkeypatch.setattr(words, "CHARS", 60)
    parts = words.grams(["ab", "", "x" * 50, *pieces], 16)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_windows_cover_every_token():
    sizes = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500])
    ids, counts = toxicity.windows(np.arange(sizes.sum()), sizes)
    assert counts[:4].tolist() == [1, 1, 1, 2] and toxicity.STRIDE * 2 == toxicity.WINDOW and set(ids[ids >= 0].tolist()) == set(range(sizes.sum()))


def test_network_gradient():
    """The training step's gradient of the loss against differences, and both forward passes agree."""
    rng = np.random.default_rng(1)
    m = toxicity.Model({"a": 1, "b": 2, "c": 3}, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    parts = m.lookup(["a", "b", "c", "dd"])
    ids = rng.integers(0, 4, (3, 6))
    ids[0, 4:] = -1
    y = np.array([1.0, 0, 1])

    def loss():
        z = m.logits(m.inputs(*parts), ids)
        p = toxicity.sigmoid(z.astype(np.float64))
        return -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-7))

    got = {}
    m._adam = lambda g, rate: got.update(g)
    m._adam_rows = lambda k, rows, v, rate: got.update({k: (rows, v)})
    assert m.step(ids, parts, y, 0.1) == pytest.approx(loss(), abs=1e-5)
    for name, at in (("att", 3), ("out", 9), ("bias", 0), ("Uf", (2, 5)), ("Ub", (1, 20)), ("Wf", (3, 1)), ("Wb", (10, 9)), ("cf", 2), ("look", 1), ("word", (2, 4))):
        old, step = m.p[name][at], 1e-2
        m.p[name][at] = old + step
        up = loss()
        m.p[name][at] = old - step
        down = loss()
        m.p[name][at] = old
        want = got["word"][1][got["word"][0].tolist().index(2), 4] if name == "word" else got[name][at]
        assert want == pytest.approx((up - down) / (2 * step), abs=3e-4)


def plain_score(m, text):
    """The network token by token, window by window."""
    p, sig = m.p, lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.H

    def vector(token):
        flat, _ = grams([toxicity.normal(token)], toxicity.GRAM_BITS)
        e = p["char"][flat].astype(np.float64)
        a = np.exp(e @ p["look"])
        return np.concatenate([p["word"][m.vocab.get(toxicity.normal(token), 0)], (e * (a / a.sum())[:, None]).sum(0)])

    def read(xs, d):
        s, out = np.zeros(h), []
        for x in xs:
            i, g = x @ p[f"W{d}"] + p[f"c{d}"], s @ p[f"U{d}"]
            z, r = sig(i[:h] + g[:h]), sig(i[h : 2 * h] + g[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(i[2 * h :] + r * g[2 * h :])
            out.append(s)
        return out

    tokens = (text or "").split()
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(tokens):
        starts.append(starts[-1] + toxicity.STRIDE)
    if not tokens:
        return float(p["bias"][0])

    def window(i):
        xs = [vector(t) for t in tokens[i : i + toxicity.WINDOW]]
        hs = np.hstack([np.array(read(xs, "f")), np.array(read(xs[::-1], "b"))[::-1]])
        a = np.exp(hs @ p["att"])
        return float((a / a.sum()) @ (hs @ p["out"]) + p["bias"][0])

    logits = [window(i) for i in starts]
    if max(logits) < toxicity.LOOK_AGAIN or len(tokens) <= toxicity.WINDOW:
        return max(logits)
    at = starts[int(np.argmax(np.round(logits, 3)))]
    near = [i for i in range(at - toxicity.STRIDE + 1, at + toxicity.STRIDE) if (i - at) % toxicity.FINE == 0 and 0 <= i <= len(tokens) - toxicity.WINDOW]
    return max(logits + [window(i) for i in near])


def test_toxicity_scores_equal_a_plain_loop(spark):
    rng = random.Random(12)
    m = toxicity.Model({w: i + 1 for i, w in enumerate(["moron", "the", "on"])}, 5)
    for k in ("att", "out"):
        m.p[k] *= 3
    texts = [*ODD, "the moron", " ".join(r[1] for r in planted(rng, 12)), *[r[1] for r in planted(rng, 6)]]
    texts += [texts[9], texts[9], "moron " * 4000, "y" * 3000]
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, texts), spark.createDataFrame([], "doc_id long, toxic int"), model=m).collect()}
    for i, t in enumerate(texts):
        assert got[i].toxicity_logit == pytest.approx(plain_score(m, t), abs=2e-3), i
    assert got[9].toxicity == got[len(texts) - 4].toxicity == got[len(texts) - 3].toxicity


def test_a_passage_between_two_windows_is_looked_at_again():
    """Windows at steps of FINE around the strongest one, and none for texts that are far from toxic or short."""
    sizes, counts = np.array([200, 200, 64, 70]), np.array([6, 6, 1, 2])
    logits = np.array([-9, -9, 1, 1, -9, -9, *[-3.1] * 6, 5, 5, 4], np.float32)
    text, start = toxicity.closer(sizes, counts, logits)
    assert set(text) == {0, 3} and start[text == 0].tolist() == [k for k in range(34, 95, 2)] and start[text == 3].tolist() == [0, 2, 4, 6]


def test_quality_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    weights = rng.standard_normal(1 << quality.BITS).astype(np.float32)
    texts = [*ODD, "on on the", " ".join(["word"] * 20_000), *[r[1] for r in planted(random.Random(1), 40)], "z" * 3000]
    texts += texts[7:20]
    d = docs(spark, texts).withColumn("Quality", F.lit("clash"))
    got = {r.doc_id: r.quality for r in quality.score_quality(d, spark.createDataFrame([], "doc_id long, quality int"), model=(weights, 0.25)).repartition(3).collect()}

    def plain(text):
        tokens = (text or "").split()
        one = []
        for t in tokens:
            flat, _ = grams([t], quality.BITS)
            word = quality.features([t])[0]
            one.append((weights[flat].astype(np.float64).sum() + weights[word[0]]) / (len(flat) + 1))
        codes = np.arange(len(tokens))
        rows, _ = quality.pairs(quality.features(tokens)[3], codes, np.array([len(tokens)])) if tokens else (codes, 0)
        z = 0.25 + (np.mean(one) if one else 0) + (weights[rows].astype(np.float64).mean() if len(rows) else 0)
        return 1 / (1 + np.exp(-z))

    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t), abs=1e-6), i
    for i in range(7, 20):  # equal texts in other batches: bit for bit
        assert got[i] == got[len(texts) - 13 + i - 7]


def planted(rng, n):
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(["the", "on", "er", "tion", "ha"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 300))]
        bad = i % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["moron", "stupid", "zqx" + rng.choice(["er", "on", "ha"])])
        rows.append((i, " ".join(w), int(bad), int(i % 2)))
    return rows


def test_toxicity_learns_and_generalises(spark):
    rows = planted(random.Random(4), 700)
    d = spark.createDataFrame([r[:2] for r in rows] + [(-1, None), (-2, "")], "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, labels, sample=(300, 200)).join(labels, "doc_id", "left").withColumn("held", held_out()).toPandas()
    assert got.toxicity.between(0, 1).all() and got[got.doc_id == -1].toxicity.item() == got[got.doc_id == -2].toxicity.item()
    h = got[got.held & got.toxic.notna()]
    assert ((h.toxicity >= 0.5) == (h.toxic == 1)).mean() > 0.95


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "bad words" if i % 2 else "good words", i % 2) for i in range(200)]
    d, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, y int")
    got = toxicity.labelled_sample(d.union(d), labels, "y", (1000, 1000))  # ids that repeat count once
    assert got.where(held_out()).count() == 0 and got.count() == labels.where(~held_out()).count() < 200
    assert toxicity.labelled_sample(d, labels, "y", (7, 9)).groupBy("y").count().sort("y").collect() == [(0, 7), (1, 9)]


def test_models_without_labels(spark):
    d = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.quality for r in quality.score_quality(d, none).collect()} == {0.5}
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score_toxicity(d, none).collect())
    assert toxicity.score_toxicity(d.limit(0), none).count() == 0


def test_quality_learns(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice(["the", "on", "er"]) for _ in range(3)) for _ in range(60)]
        good = i % 4 > 0
        rows.append((i, " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + "***" for x in w), "on " * 60]), int(good)))
    d, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = quality.score_quality(d, labels).withColumnRenamed("quality", "score").join(labels, "doc_id").withColumn("held", held_out()).toPandas()
    h = got[got.held]
    assert ((h.score >= 0.3) == (h.quality == 1)).mean() > 0.97


# -- pipeline


def test_stages_of_odd_tables(spark, sf):
    """Empty tables, nulls in any column, empty and very long texts, repeated rows, names that clash."""
    import corpus_pipeline as p

    odd = docs(spark, [*ODD, "word " * 30_000, "one two three", "one two three"], ids=[None, None, *range(len(ODD) + 1)])
    odd = odd.withColumn("source", F.when(F.col("doc_id") > 2, F.col("source"))).withColumns({c: F.lit(c) for c in ("size", "toxicity", "sid", "row", "doc", "id", "shard", "spans", "bin", "place", "root", "line", "nos")})
    for d in (odd, odd.limit(0)):
        for name, stage in p.STAGES:
            got = stage(spark, d, sf)
            if name == "best-fit packing":
                assert got.agg(F.sum("n_words")).first()[0] == d.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0]
            else:
                assert got.columns == d.columns and got.select("size", "sid", "row", "doc", "spans").distinct().count() == min(1, d.count())


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = p.documents(spark, sf)
    kept = p.keep(p.drop_toxic(spark, d, sf), "kept")
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    lines = p.keep(p.dedup_lines(spark, kept, sf), "lines")
    one = p.keep(p.drop_near_duplicates(spark, lines, sf), "one")
    texts = {r.doc_id: r.text for r in lines.collect()}
    order = sorted(texts)
    want = {order[c] for _, c in brute_components([texts[i] for i in order], 5, 80).values()}
    assert p.drop_toxic(spark, d.limit(9).withColumn("toxicity", F.lit(7)), sf).select("toxicity").distinct().collect() == [(7,)]
    assert lines.count() == kept.count() and {r.doc_id for r in one.collect()} == want
    mixed = p.keep(p.mix(spark, one, sf), "mixed")
    sizes = Counter()
    for r in one.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names, targets, open_, left = sorted(sizes), {}, set(sizes), sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while open_:  # a target stops at three times its source
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 3 * sizes[s]]
        if not over:
            targets |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        targets |= {s: 3 * sizes[s] for s in over}
        open_ -= set(over)
        left = sum(sizes.values()) - sum(targets.values())
    took, known = Counter(), {r.doc_id: Counter((r.text or "").split()) for r in one.collect()}
    for r in mixed.collect():
        took[r.source] += len(r.text.split()) if r.text else 0
        assert not Counter((r.text or "").split()) - known[r.doc_id]
    assert mixed.columns == d.columns and all(abs(took[s] - targets[s]) <= 0.02 * targets[s] + 64 for s in names)
    packed = p.keep(p.run(spark, sf), "packed")
    assert packed.agg(F.sum("n_words")).first()[0] == sum(took.values()) == p.pack(spark, mixed, sf).agg(F.sum("n_words")).first()[0]
    room = packed.where("bin is not null").groupBy("shard", "bin").agg(F.sum("n_words").alias("n"), F.max(F.col("place") + F.col("n_words")).alias("end"))
    assert room.where("n <> `end` or n > 2048").count() == 0 and packed.where("bin is null and n_words > 0").count() == 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "near duplicates", "source mix", "best-fit packing"]


def test_strangers_meet_a_large_component_once(spark):
    met = spark.range(1, 5000).selectExpr("7L as key", "0L as leader", "id as sid").unionByName(spark.createDataFrame([(7, 0, 9999)], "key long, leader long, sid long"))
    roots = spark.range(5000).selectExpr("id as sid", "0L as root")
    sketches = spark.range(10_000).selectExpr("id as sid", "300L as size", "cast('x' as binary) as sketch")
    tiles = ngramjoin.bucket_tiles(met, roots, sketches)
    assert tiles.select("key", "i", "j").distinct().count() <= 2
    assert tiles.count() <= 5002 and tiles.where("sid = 9999").count() == tiles.select("i", "j").distinct().count()
    few = spark.createDataFrame([(7, 0, k) for k in (10_001, 10_002)], "key long, leader long, sid long")
    tiles = ngramjoin.bucket_tiles(met.unionByName(few), roots, spark.range(10_010).selectExpr("id as sid", "300L as size", "cast('x' as binary) as sketch"))
    for a, b in ((9999, 10_001), (10_001, 10_002), (3, 10_002), (4999, 9999)):  # every pair of different components shares one tile
        x, y = (tiles.where(f"sid = {k}").select("i", "j", F.col("part").alias(c)) for k, c in ((a, "x"), (b, "y")))
        assert x.join(y, ["i", "j"]).where("x <> y or i = j").count() == 1


def test_sample_has_a_bound_in_characters(spark):
    d = spark.createDataFrame([(i, "x" * 100) for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, None), (2, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(d, labels, "toxic", (20, 20), chars=1000).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 10, 1: 10}


def test_toxicity_holds_a_part_of_a_batch_at_a_time(monkeypatch):
    """Batches of more different tokens than the table holds: memory stays bounded, scores are those of each text alone."""
    batch = pa.array([" ".join(f"{i}w{k}" for k in range(120)) + " the moron" for i in range(2000)] + [None, ""])
    m = toxicity.Model({"moron": 1, "the": 2}, 5)
    score = toxicity.Scorer(m, kept=100_000)
    tracemalloc.start()
    try:
        got = score(batch)
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()
    assert len(score.kinds) <= 100_000 and len(got) == len(batch)
    some = [0, 1, 999, 1998, 1999, 2000, 2001]
    assert np.round([score(batch.slice(i, 1))[0] for i in some], 4).tolist() == np.round(got[some], 4).tolist()
    for together, tokens, kept in ((100, 10, 5), (5_000, 700, 300), (1 << 30, 1 << 30, 0)):
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        monkeypatch.setattr(toxicity, "TOKENS", tokens)
        assert np.round(toxicity.Scorer(m, kept)(batch[1900:]), 4).tolist() == np.round(got[1900:], 4).tolist()


def test_toxicity_trains_with_tables_of_the_next_documents(monkeypatch):
    """The windows of 512 documents are looked through with a table of their own tokens, not of all."""
    made, inputs = [], toxicity.Model.inputs
    monkeypatch.setattr(toxicity.Model, "inputs", lambda m, rows, *parts: made.append(len(rows)) or inputs(m, rows, *parts))
    toxicity.train([f"only{i} the moron" if i % 2 else None if i % 4 else f"only{i} the" for i in range(1100)], [i % 2 for i in range(1100)], epochs=1, steps=1)
    assert len(made) == 3 and max(made) <= 514
