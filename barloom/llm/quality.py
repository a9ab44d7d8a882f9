"""Quality classifier: supervised subword embeddings.

Every token is the mean of learned vectors: one of its word, and one of each of its character 3- to
6-grams; every pair of neighbouring tokens has a vector, too. All are rows of one table, found by
hash (a word said twice shares one). A document is the mean of its tokens plus the mean of its pairs; a softmax over two outputs
tells its quality. Table and outputs are learned in numpy by stochastic gradient descent.

Training: a bounded sample of labelled documents, at most sample[0] of label 0 and sample[1] of label 1
(in order of a hash of the id, never held-out ones; one row of each id), read whole. Scoring reads every whole text: as the
model is linear in its vectors, the table is sent as one number per row.

Nulls and empty texts score by the outputs' bias alone. Equal texts, and repeated rows, have equal scores, bit
for bit: a text's sums depend on nothing else in its batch. A column named quality is replaced. Without labels of
both kinds the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import in_utc
from .common import small_batches
from .toxicity import fit, labelled_sample, sigmoid
from .words import coded, grams

BITS, DIM = 18, 10


def features(kinds: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the row of its word, rows of its n-grams (one after another) and how many, a hash of its word."""
    flat, sizes = grams(kinds, BITS)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))
    return (words >> np.uint64(64 - BITS)).astype(np.int32), flat, sizes, words


def pairs(words: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for neighbouring tokens, and how many each text has."""
    w = words[codes]
    p = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    p[w[:-1] == w[1:]] = 1  # a word said twice is one kind of pair, whatever the word
    last = np.cumsum(sizes)[sizes > 0] - 1
    inside = np.ones(max(0, len(w) - 1), bool)
    inside[last[last < len(inside)]] = False
    return (p[inside] >> np.uint64(64 - BITS)).astype(np.int64), np.maximum(sizes - 1, 0)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of runs of so many values, each added up in its own order; 0 of none."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if values.ndim == 1:
        return np.bincount(owner, values, len(sizes))
    return np.stack([np.bincount(owner, v, len(sizes)) for v in values.T], 1)


def train(texts: list[str | None], labels: list[int], epochs: int = 5, batch: int = 32, rate: float = 150.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """What each row of the table adds to the logit of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    table = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if len(set(labels)) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    out[:] = rng.standard_normal((DIM, 2)) / np.sqrt(DIM)
    kinds, codes, sizes = coded(pa.array(texts, pa.string()))
    word, flat, many, words = features(kinds)
    del kinds
    first = np.cumsum(many) - many
    ends = np.cumsum(sizes)
    y = np.eye(2, dtype=np.float32)[np.array(labels)]
    order = [rng.permutation(len(y)) for _ in range(epochs)]
    steps, done = epochs * -(-len(y) // batch), 0
    for some in order:
        for i in range(0, len(some), batch):
            docs = some[i : i + batch]
            n = sizes[docs]
            c = codes[np.repeat(ends[docs] - np.cumsum(n), n) + np.arange(n.sum())]
            used, where = np.unique(c, return_inverse=True)
            k = many[used]
            rows = flat[np.repeat(first[used] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            vec = (np.add.reduceat(table[rows], np.cumsum(k) - k) + table[word[used]]) / (k + 1)[:, None] if len(k) else np.zeros((0, DIM), np.float32)
            p_rows, p_n = pairs(words, c, n)
            x = sums(vec[where], n) / np.maximum(n, 1)[:, None] + sums(table[p_rows], p_n) / np.maximum(p_n, 1)[:, None]
            z = x @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - y[docs]) / len(docs)
            dx = g @ out.T
            speed = rate * (1 - done / steps)
            done += 1
            d_token = np.repeat(dx / np.maximum(n, 1)[:, None], n, 0)
            d_vec = np.zeros((len(used), DIM))
            np.add.at(d_vec, where, d_token)
            d_vec *= -speed / (k + 1)[:, None]
            np.add.at(table, rows, np.repeat(d_vec, k, 0).astype(np.float32))
            np.add.at(table, word[used], d_vec.astype(np.float32))
            np.add.at(table, p_rows, (-speed * np.repeat(dx / np.maximum(p_n, 1)[:, None], p_n, 0)).astype(np.float32))
            out -= (speed / 30) * (x.T @ g).astype(np.float32)
            bias -= (speed / 30) * g.sum(0)
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        kinds, codes, sizes = coded(texts)
        if not len(codes):
            return np.full(len(sizes), self.bias)
        word, flat, many, words = features(kinds)
        token = (sums(self.weights[flat], many) + self.weights[word]) / (many + 1)
        rows, n = pairs(words, codes, sizes)
        return self.bias + sums(token[codes], sizes) / np.maximum(sizes, 1) + sums(self.weights[rows], n) / np.maximum(n, 1)


def score_quality(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (1000, 2000), model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """`docs` with quality (0 to 1)."""
    spark = docs.sparkSession
    small_batches(spark, 2048)
    if model is None:
        model = fit(labelled_sample(docs, labels, "quality", sample), train)
    sent = spark.sparkContext.broadcast(model)  # a number for each row of the table: of fixed size
    names = [c for c in docs.columns if c.lower() != "quality"]
    schema = docs.select(*[f"`{c}`" for c in names], F.lit(0.0).alias("quality")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*sent.value)
        for b in in_utc(batches):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sigmoid(score(b.column("text"))))], schema.names)

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
