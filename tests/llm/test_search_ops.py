"""Lexical search, winnowing and the prefix trie: brute force, odd inputs, SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import entries, lexical, prefixtrie, winnow
from barloom.llm.oracles import ORACLES

duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, item string, n long, fp string, words string, rank string"
ODD = [None, "", " ", "...", "one", "one", "One TWO one", "word " * 9000, "Ünï ÉTÉ été 文字 😀 ß", "x" * 30_000, "tab\tsep\x0bv\x85n b", "ab1 AB1 a-b-1"]
TERM, WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None, "s", 1, "i", 5, "f", "w", "r") for i, t in enumerate(texts)], DOCS)


def items(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def some_texts(rng, n, words=60):
    vocabulary = [f"w{i}" for i in range(90)] + ["Été", "été", "ß"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cur = con.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == cols
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str([r[at[c]] for c in cols]) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_winnowing", "op13_prefix_trie"])
def test_as_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


# -- op11


def plain_search(texts, ids, queries, k=20):
    terms = [re.findall(TERM, low(t)) for t in texts]
    held = [i for i, t in enumerate(terms) if t]
    n_docs, total = len(held), sum(len(terms[i]) for i in held)
    df = Counter(x for i in held for x in set(terms[i]))
    out = set()
    for item, text in queries.items():
        asked, scores = re.findall(TERM, low(text)), []
        for i in held:
            tf, m = Counter(terms[i]), 100 - 25 + 25 * len(terms[i]) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1))) * (10**9 * tf[q] // (1000 * tf[q] + 12 * m)) for q in asked if tf[q])
            if s > 0:
                scores.append((-s, ids[i] is None, ids[i] or 0, ids[i]))
        out |= {(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 12])
def test_search_equals_brute_force(spark, block_terms):
    rng = random.Random(3)
    texts = [*ODD, *some_texts(rng, 60), *some_texts(rng, 3) * 9]
    ids = [None, None, *range(5, 2 * len(texts), 2)][: len(texts)]
    ids[40] = ids[41]
    asked = ["one word", "w1 w2 W2 w3", None, "", "...", "Été ÉTÉ", "ab1", "nowhere", *some_texts(rng, 6, 20)]
    got = lexical.search(docs(spark, texts, ids).repartition(5), items(spark, asked), block_terms=block_terms)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_search(texts, ids, dict(enumerate(asked)))


def test_search_of_repeated_items_and_empty_tables(spark):
    d = docs(spark, ["a b c", "b", None])
    got = lexical.search(d, items(spark, ["a", "b", "zz"], ids=[7, 7, None]))
    assert {(r.item_id, r.rank, r.doc_id) for r in got.collect()} == {(7, 1, 0), (7, 2, 1)}
    for x in (lexical.search(d.limit(0), items(spark, ["a"])), lexical.search(d, items(spark, ["a"]).limit(0)), lexical.search(d, items(spark, [None, "-"]))):
        assert x.columns == ["item_id", "rank", "doc_id", "score"] and x.count() == 0


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(1)
    best, every = lexical.Best(3, 4), []
    for _ in range(40):
        n = rng.integers(1, 30)
        rows = np.stack([rng.integers(0, 3, n), rng.integers(1, 6, n), rng.integers(0, 2, n), rng.integers(0, 50, n)])
        every += rows.T.tolist()
        ok = rows[1] >= best.least[rows[0]]
        best.add(*rows[:, ok])
    want = [x for i in range(3) for x in sorted((r for r in every if r[0] == i), key=lambda r: (-r[1], r[2], r[3]))[:4]]
    assert best.rows.T.tolist() == want


# -- op12


def plain_leaks(texts, asked, size=10):
    windows = defaultdict(set)
    for name, t in asked:
        w = re.findall(WORD, low(t))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("" if name is None else str(name))
    out = []
    for t in texts:
        w = re.findall(WORD, low(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("most", [winnow.BROADCAST_ROWS, 0])
def test_winnowing_equals_brute_force(spark, monkeypatch, short, most):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", most)
    rng = random.Random(7)
    asked = [(i, t) for i, t in enumerate(some_texts(rng, 12, 40)) if short or len(t.split()) >= 10]
    asked += [(900, asked[0][1]), (900, "ha " * 30), (1000, asked[1][1]), (None, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"), (33, None), (34, "?!")]
    asked += [(50, "w1"), (51, "W2 w3"), (52, "Été w1 w2 w3")] if short else []
    texts = [*ODD, *some_texts(rng, 40, 30), "ha " * 9, "ha, " * 25, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10"]
    for _ in range(40):
        w = rng.choice(asked)[1] or ""
        words = w.split()
        i, n = rng.randint(0, max(0, len(words) - 9)), rng.randint(8, 14)
        texts.append(" ".join([*some_texts(rng, 1, 12), *words[i : i + n], *some_texts(rng, 1, 12), *(words[:11] if rng.random() < 0.4 else [])]))
    texts += texts[-3:] * 3
    ids = [None, None, *range(len(texts))][: len(texts)]
    got = winnow.decontaminate(docs(spark, texts, ids), items(spark, [t for _, t in asked], ids=[i for i, _ in asked]))
    want = [(i, *x) for i, x in zip(ids, plain_leaks(texts, asked), strict=True)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert any(x[-1] for x in want) and not all(x[-1] for x in want)


def test_winnowing_of_empty_tables(spark):
    d, a = docs(spark, ["a b c", None]), items(spark, ["a b"])
    assert winnow.decontaminate(d.limit(0), a).count() == 0
    got = {r.doc_id: r for r in winnow.decontaminate(d, a.limit(0)).collect()}
    assert got[0].n_words == 3 and not got[0].contaminated and got[1].n_words == 0 and got[1].n_items == 0


def test_winnowing_has_no_python(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = spark.read.parquet(f"{sf}/benchmark.parquet")
    w = winnow.windows_of(a).withColumn("span", F.array_join("words", " "))
    for x in (winnow.candidates(d, w.select(F.xxhash64("words").alias("fp")), [10]), w):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# -- op13


def plain_trie(rows):
    """Nodes of rebuilt conversations from rows (conv_id, turn, role, text), without ties in (conv_id, turn)."""
    turns = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()]


def trie(spark, rows):
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, shard string, depth long")
    return [tuple(r) for r in prefixtrie.rebuilt_trie(d).collect()]


@pytest.mark.parametrize(("segment", "shard_rows"), [(1024, 200_000), (1024, 40)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, shard_rows):
    monkeypatch.setattr(prefixtrie, "SHARD_ROWS", shard_rows)
    rng = random.Random(5)
    texts = ["hello", "", None, "é", "b"]
    rows = []
    for c in [*range(0, 120), 5000, 5003, 2**40 + 1]:
        if c % 5 == 0 and rng.random() < 0.3:
            continue  # no conversation to begin with
        turns = rng.sample(range(30), rng.randint(1, 14))
        rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in turns]
    for c in range(200, 400):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(6)]
    rows += [(None, 1, "user", "nobody's")]
    got = trie(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, plain_trie(rows)))


def test_trie_of_long_conversations(spark):
    rows = [(c, t, "user", f"{t % 7}" if t < 2500 + 10 * c else f"own {c}") for c in (0, 1, 2, 3, 7) for t in range(2500 + 300 * c)]
    assert sorted(map(str, trie(spark, rows))) == sorted(map(str, plain_trie(rows)))


def test_trie_of_no_conversations_and_repeated_rows(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 0, "user", "x")]) == []
    got = trie(spark, [(10, 1, "user", "x")] * 12)
    assert sorted(r[1] for r in got) == list(range(13)) and all(r[5] == 1 for r in got)


def test_node_table_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 30_000):
        hi, lo = rng.integers(-(1 << 62), 1 << 62, (2, n))
        hi[: n // 2] = 7  # keys that share a half
        table = prefixtrie.NodeTable(hi, lo)
        assert sorted(table.slots(hi, lo)) == list(range(n))
        assert (table.slots(hi, lo + 1) == -1).all()
