"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index.

The terms of all items are one automaton, broadcast to the tasks. A text is reduced to its terms with one blank before
and after each (bytes: separators become blanks, only A-Z is lower-cased), and every pattern has a blank on both sides,
so the automaton finds whole terms only and gives their counts straight from the text. A first scan adds up how many
documents hold a term, how many documents there are and how many terms; a second one scores each document for all
items (automaton outputs map to items) and keeps each item's best of a task; Spark ranks these.

Items are dealt in blocks of at most BLOCK_TERMS terms, so that what is broadcast has a bound whatever the number of
items; each block is a scan of its own over all documents. Nothing of a document but its scores leaves a task.

Nulls: a null text has no terms; a null doc_id counts as a document and ranks after equal scores with an id; rows
that share an id are documents of their own; an item without terms, or one that no document shares a term with, has
no rows. Items that share an id are one item, with the terms of all their texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import texts
from .common import small_batches

#: Item terms, with repeats, in one automaton: some 40 MB in a Python worker.
BLOCK_TERMS = 200_000
#: Cells of (documents x items) that are scored at once, and postings at once.
CELLS, POSTINGS = 1 << 20, 1 << 21
#: Separators become blanks, A-Z is lower-cased, bytes of other characters stay.
_FIXED = {i: 32 for i in range(128)} | {i: i for i in range(128, 256)} | {i: i for i in b"0123456789abcdefghijklmnopqrstuvwxyz"} | {i: i + 32 for i in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TABLE = bytes(_FIXED[i] for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Terms of a block of items with where they stand: postings of a term are items and how often they have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names = [name for name, _ in items]
        counts: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, terms) in enumerate(items):
            for t, c in Counter(terms).items():
                counts.setdefault(t, []).append((i, c))
        self.terms = sorted(counts)
        self.machine = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            self.machine.add_word(f" {t.decode('latin-1')} ", k)
        if self.terms:
            self.machine.make_automaton()
        flat = [x for t in self.terms for x in counts[t]]
        self.item, self.times = (np.array([x[j] for x in flat], np.int64) for j in (0, 1))
        self.starts = np.cumsum([0, *[len(counts[t]) for t in self.terms]])

    def scan(self, text: bytes) -> tuple[int, Counter]:
        """Number of terms of a text, and how often the items' terms stand in it."""
        terms = terms_of(text)
        if not terms or not self.terms:
            return len(terms), Counter()
        guarded = (b" " + b" ".join(terms) + b" ").decode("latin-1")
        return len(terms), Counter(map(itemgetter(1), self.machine.iter(guarded)))



# -- first scan: statistics

#: Rows of the first scan that are no term: documents with terms, and their terms.
N_DOCS, N_TERMS = -1, -2


def count_terms(items: list[tuple[int, list[bytes]]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of a task: documents that hold the term, or the totals."""
    a = Automaton(items)
    df, docs, total = np.zeros(len(a.terms), np.int64), 0, 0
    for b in batches:
        for t in texts(b.column(0)):
            n, found = a.scan(t)
            if n:
                docs, total = docs + 1, total + n
                df[list(found)] += 1
    some = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.r_[some, N_DOCS, N_TERMS], pa.int64()), pa.array(np.r_[df[some], docs, total], pa.int64())], names=["term", "n"])


# -- second scan: scores


class Best:
    """The k best (score, doc) of each item so far: higher scores first, then smaller ids, rows without id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.rows = np.empty((4, 0), np.int64)  # item, score, whether the id is null, id

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([item, score, null, doc])], 1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        new = np.r_[True, rows[0, 1:] != rows[0, :-1]] if rows.shape[1] else np.empty(0, bool)
        rank = np.arange(rows.shape[1]) - np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))
        self.rows = rows[:, rank < self.k]
        full = rows[:, rank == self.k - 1]
        self.least[full[0]] = full[1]


def score_documents(items: list[tuple[int, list[bytes]]], weights: list[int], n_docs: int, n_terms: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's k best documents of a task."""
    a, w = Automaton(items), np.array(weights, np.int64)
    best, size = Best(len(a.names), k), np.diff(a.starts)
    step = max(1, CELLS // max(1, len(a.names)))
    for b in batches:
        all_texts, ids = texts(b.column("text")), b.column("doc_id")
        null, ids = np.asarray(ids.is_null()).astype(np.int64), np.asarray(ids.fill_null(0), np.int64)
        for i in range(0, len(all_texts), step):
            cells = np.zeros((min(step, len(all_texts) - i), len(a.names)), np.int64)
            doc, term, value = _values(a, w, n_docs, n_terms, all_texts[i : i + step])
            ends = np.cumsum(size[term])
            cuts = np.searchsorted(ends, np.arange(POSTINGS, ends[-1] if len(ends) else 0, POSTINGS))
            for d, t, v in zip(np.split(doc, cuts), np.split(term, cuts), np.split(value, cuts), strict=True):
                n = size[t]
                at = np.repeat(a.starts[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
                np.add.at(cells, (np.repeat(d, n), a.item[at]), np.repeat(v, n) * a.times[at])
            d, item = np.nonzero((cells > 0) & (cells >= best.least))
            if len(d):
                best.add(item, cells[d, item], null[i + d], ids[i + d])
    item, score, null, doc = best.rows
    yield pa.record_batch([pa.array(np.array(a.names, np.int64)[item]), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])


def _values(a: Automaton, w: np.ndarray, n_docs: int, n_terms: int, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, term, w * ((10**9 * tf) div (1000 * tf + 12 * m)) of each document and item term in it."""
    doc, term, tf, m = [], [], [], np.zeros(len(some), np.int64)
    for i, t in enumerate(some):
        n, found = a.scan(t)
        if found:
            m[i] = 75 + 25 * n * n_docs // n_terms
            doc.append(np.full(len(found), i))
            term += found.keys()
            tf += found.values()
    doc, term, tf = np.concatenate([np.empty(0, np.int64), *doc]), np.array(term, np.int64), np.array(tf, np.int64)
    return doc, term, w[term] * (10**9 * tf // (1000 * tf + 12 * m[doc]))


# -- search


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> tuple[DataFrame, int]:
    """Items (item_id, text) with the block that each belongs to, and the number of blocks: as many as the terms need."""
    d = items.select("item_id", "text").withColumn("n", F.expr(r"size(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0))")).where("n > 0")
    total = d.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // most)
    return d.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))), blocks


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. docs: doc_id, text. items: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    dealt, blocks = item_blocks(items, block_terms)
    d, parts = docs.select("doc_id", "text"), []
    schema = "item long, doc_id long, score long"
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item_id", "text").collect()  # at most about block_terms terms
        if not rows:
            continue
        terms: dict[object, list[bytes]] = {}
        for r in rows:
            terms.setdefault(r.item_id, []).extend(terms_of(r.text.encode()))
        names = list(terms)
        shared = spark.sparkContext.broadcast(list(enumerate(terms.values())))
        counted = d.select("text").mapInArrow(lambda b, s=shared: count_terms(s.value, b), "term long, n long")
        df = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term of the block
        n_docs, n_terms = df.get(N_DOCS, 0), df.get(N_TERMS, 0)
        if not n_docs:
            break
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len({x for y in terms.values() for x in y}))]
        scored = d.mapInArrow(lambda b, s=shared, w=weights, n=n_docs, m=n_terms: score_documents(s.value, w, n, m, k, b), schema)
        ids = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {dict(items.dtypes)['item_id']}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(top.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))  # ids: a block
    if not parts:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
