"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token is a vector of its word (embedded if the training sample has it twice or more) and one of its
characters: attention pools the embeddings of its hashed 3- to 6-grams. Two GRUs read a window of tokens, forwards and backwards; attention
pools their states into the window's logit. A document's logit is the largest of its windows. These overlap by half
and cover the whole text; where the strongest is not far from toxic, all windows around it are read at steps of two, so
that a passage lies whole in one.

Training: a bounded sample of labelled documents, at most sample[0] clean and sample[1] toxic ones (in
order of a hash of the id, never held-out ones; one row of each id), read whole: each step looks through all
windows of its documents and pushes each document's strongest. Scoring covers every window of every document.

Nulls and empty texts score as one window of no tokens. Equal texts, and repeated rows, score alike: windows
are read in batches of one shape, and logits are rounded to 4 places. Without labels of both kinds all
texts have one score, from the numbers of labels (1/3 without any, so nothing is rejected). Columns of `docs` named like the results are replaced; `out` names the results.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import give_back, in_utc
from .common import held_out, small_batches
from .words import SOME, coded, grams, spans

WINDOW, STRIDE = 64, 32
#: A text whose strongest window has this logit is looked at again around it, window by window at this step.
LOOK_AGAIN, FINE = -3.0, 2
DW, DC, H = 8, 8, 8
GRAM_BITS = 17
GRAMS = 1 << GRAM_BITS
#: Windows that are read together, and n-grams whose vectors are pooled at once (a token more at most).
BATCH, POOL = 512, 100_000
#: Bytes of texts that are split into tokens at once, and tokens whose windows are made at once (a text more at most).
TOGETHER, TOKENS = 1 << 20, 1 << 20


def normal(token: str) -> str:
    return token.lower().strip(punctuation) or token


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Model:
    """Weights, and the vocabulary that maps normal tokens to rows of the word table (0: unknown)."""

    def __init__(self, vocab: dict[str, int], seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0] if len(s) > 1 else 1))).astype(np.float32)
        self.vocab = vocab
        self.p = {"word": 0.1 * rng.standard_normal((len(vocab) + 1, DW)).astype(np.float32), "char": 0.1 * rng.standard_normal((GRAMS, DC)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(DW + DC, 3 * H), f"U{d}": f(H, 3 * H), f"c{d}": np.zeros(3 * H, np.float32)}
        self.p |= {"look": np.eye(DC, dtype=np.float32)[0], "att": 0.1 * f(2 * H), "out": f(2 * H), "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.steps = 0

    # -- tokens

    def lookup(self, kinds: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the word table, n-grams one after another, and how many each token has."""
        ns = [normal(k) for k in kinds]
        return np.array([self.vocab.get(n, 0) for n in ns], np.int64), *grams(ns, GRAM_BITS)

    def vectors(self, rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, DW + DC), np.float32)
        e, a, at = self.pooled(flat, sizes)
        return np.hstack([self.p["word"].take(rows, 0), np.add.reduceat(e * a[:, None], at)])

    def pooled(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of n-grams, their attention within their token, and where each token starts."""
        e, at = self.p["char"].take(flat, 0), np.cumsum([0, *sizes[:-1]])
        a = np.exp(np.clip(e @ self.p["look"], -20, 20))
        return e, a / np.repeat(np.add.reduceat(a, at), sizes), at

    # -- one direction of the network; x: (time, windows, 3H) inputs, already in reading order

    def _scan(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: list | None = None) -> Iterator[np.ndarray]:
        h = np.zeros((x.shape[1], H), np.float32)
        for t in range(len(x)):
            g = h @ u
            zr = sigmoid(x[t, :, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[t, :, 2 * H :] + r * g[:, 2 * H :])
            new = (n + z * (h - n)) * mask[t][:, None]
            if trace is not None:
                trace.append((h, z, r, n, g[:, 2 * H :]))
            h = new
            yield h

    def inputs(self, rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, 3H) for each direction: what tokens bring to its gates, as logits() reads it. The gates'
        arguments are halved, since their sigmoid is taken by tanh. A last row: no token."""
        out = tuple(np.zeros((len(rows) + 1, 3 * H), np.float32) for _ in "fb")
        ends, i = np.cumsum(sizes), 0
        while i < len(rows):  # some at a time: n-grams are many
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + POOL, "right")))
            v = self.vectors(rows[i:j], flat[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j])
            for d, x in zip("fb", out, strict=True):
                x[i:j] = v @ self.p[f"W{d}"] + self.p[f"c{d}"]
            i = j
        for x in out:
            x[:, : 2 * H] *= 0.5
        return out

    def logits(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Of windows ids (windows, time); -1: no token. Both directions step together: the columns of a
        state are the forward, then the backward one, those of the gates z, r, n, each for both."""
        n, some = ids.shape[1], len(ids)
        u = np.zeros((2 * H, 6 * H), np.float32)
        for k in range(3):
            u[:H, 2 * k * H : (2 * k + 1) * H] = self.p["Uf"][:, k * H : (k + 1) * H] * (0.5 if k < 2 else 1)
            u[H:, (2 * k + 1) * H : (2 * k + 2) * H] = self.p["Ub"][:, k * H : (k + 1) * H] * (0.5 if k < 2 else 1)
        read = np.zeros((2 * H, 4), np.float32)
        read[:H, 0], read[:H, 1], read[H:, 2], read[H:, 3] = self.p["att"][:H], self.p["out"][:H], self.p["att"][H:], self.p["out"][H:]
        mask = np.ascontiguousarray((ids >= 0).T, np.float32)
        steps = np.ascontiguousarray(np.where(ids >= 0, ids, len(table[0]) - 1).T)
        full = mask.min(1) > 0
        s = np.zeros((n, some, 2), np.float32)
        h, x, g = np.zeros((some, 2 * H), np.float32), np.empty((some, 3, 2, H), np.float32), np.empty((some, 6 * H), np.float32)
        flat = x.reshape(some, 6 * H)
        ahead, behind = table
        for t in range(n):
            x[:, :, 0] = ahead.take(steps[t], 0).reshape(some, 3, H)
            x[:, :, 1] = behind.take(steps[n - 1 - t], 0).reshape(some, 3, H)
            np.matmul(h, u, out=g)
            zr = flat[:, : 4 * H] + g[:, : 4 * H]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new = g[:, 4 * H :]
            new *= zr[:, 2 * H :]
            new += flat[:, 4 * H :]
            np.tanh(new, out=new)
            h -= new
            h *= zr[:, : 2 * H]
            h += new
            if not (full[t] and full[n - 1 - t]):
                h[:, :H] *= mask[t][:, None]
                h[:, H:] *= mask[n - 1 - t][:, None]
            r = h @ read
            s[t] += r[:, :2]
            s[n - 1 - t] += r[:, 2:]
        a = np.where(mask > 0, s[:, :, 0], -1e9)
        a = np.exp(a - a.max(0)) * mask
        return (a * s[:, :, 1]).sum(0) / np.maximum(a.sum(0), 1e-9) + self.p["bias"][0]

    def window_logits(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """logits() of any number of windows, in batches of one shape."""
        n = len(ids)
        ids = np.concatenate([ids, np.full((-n % BATCH, ids.shape[1]), -1, ids.dtype)])
        return np.concatenate([self.logits(table, ids[i : i + BATCH]) for i in range(0, len(ids), BATCH)])[:n]

    # -- training

    def step(self, ids: np.ndarray, parts: tuple[np.ndarray, ...], y: np.ndarray, rate: float) -> float:
        """One Adam step on windows ids (windows, time; -1: none) of kinds with these parts (see lookup), with labels y."""
        p, kinds = self.p, np.unique(ids[ids >= 0])
        local = np.searchsorted(kinds, np.maximum(ids, 0).clip(min=kinds[0] if len(kinds) else 0)).T
        mask = (ids >= 0).astype(np.float32).T
        word, flat, size = parts_of(parts, kinds)
        v = self.vectors(word, flat, size)
        x = v[local.clip(max=len(kinds) - 1)] * mask[:, :, None]
        n = len(mask)
        trace, hs = {"f": [], "b": []}, {}
        for d in "fb":
            inp = x if d == "f" else x[::-1]
            m = mask if d == "f" else mask[::-1]
            hs[d] = np.stack(list(self._scan(inp @ p[f"W{d}"] + p[f"c{d}"], m, p[f"U{d}"], trace[d])))
        h = np.concatenate([hs["f"], hs["b"][::-1]], 2)
        a = np.where(mask > 0, h @ p["att"], -1e9)
        a = np.exp(a - a.max(0)) * mask
        a /= np.maximum(a.sum(0), 1e-9)
        o = h @ p["out"]
        logit = (a * o).sum(0) + p["bias"][0]
        prob = sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)))
        d_logit = (prob - y) / len(y)
        da = a * (o - (a * o).sum(0)) * d_logit
        do = a * d_logit
        g = {"bias": np.array([d_logit.sum()], np.float32), "att": np.einsum("tb,tbh->h", da, h), "out": np.einsum("tb,tbh->h", do, h)}
        dh_all = da[:, :, None] * p["att"] + do[:, :, None] * p["out"]
        dx = np.zeros_like(x)
        for d in "fb":
            inp, m = (x, mask) if d == "f" else (x[::-1], mask[::-1])
            dhs = dh_all[:, :, :H] if d == "f" else dh_all[::-1, :, H:]
            u, gw, gu, gc = p[f"U{d}"], np.zeros_like(p[f"W{d}"]), np.zeros_like(p[f"U{d}"]), np.zeros(3 * H, np.float32)
            carry = np.zeros((x.shape[1], H), np.float32)
            for t in range(n - 1, -1, -1):
                h0, z, r, nn, gn = trace[d][t]
                dh = (dhs[t] + carry) * m[t][:, None]
                dn = dh * (1 - z) * (1 - nn * nn)
                dz = dh * (h0 - nn) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.hstack([dz, dr, dn * r])
                di = np.hstack([dz, dr, dn])
                carry = dh * z + dg @ u.T
                gu += h0.T @ dg
                gw += inp[t].T @ di
                gc += di.sum(0)
                back = di @ p[f"W{d}"].T
                dx[t if d == "f" else n - 1 - t] += back
            g |= {f"W{d}": gw, f"U{d}": gu, f"c{d}": gc}
        dx *= mask[:, :, None]
        dv = np.zeros((len(kinds), DW + DC), np.float32)
        np.add.at(dv, local[mask > 0], dx[mask > 0])
        used, where = np.unique(word, return_inverse=True)
        gw = np.zeros((len(used), DW), np.float32)
        np.add.at(gw, where, dv[:, :DW])
        if len(used) and used[0] == 0:
            gw[0] = 0
        who = np.repeat(np.arange(len(kinds)), size)
        e, a, at = self.pooled(flat, size)
        de = dv[:, DW:][who]
        da = (e * de).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, at), size))
        g["look"] = da @ e
        de = a[:, None] * de + da[:, None] * self.p["look"]
        guse, gwhere = np.unique(flat, return_inverse=True)
        gc = np.zeros((len(guse), DC), np.float32)
        np.add.at(gc, gwhere, de)
        self._adam(g, rate)
        self._adam_rows("word", used, gw, rate)
        self._adam_rows("char", guse, gc, rate)
        return loss

    def _adam(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, v in g.items():
            m, s = self.moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-6)

    def _adam_rows(self, k: str, rows: np.ndarray, v: np.ndarray, rate: float) -> None:
        m, s = self.moment[k]
        m[rows] += 0.1 * (v - m[rows])
        s[rows] += 0.01 * (v * v - s[rows])
        self.p[k][rows] -= rate * (m[rows] / (1 - 0.9**self.steps)) / (np.sqrt(s[rows] / (1 - 0.99**self.steps)) + 1e-6)


def parts_of(parts: tuple[np.ndarray, ...], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of some kinds (see Model.lookup)."""
    size, starts = parts[2][kinds], np.cumsum(parts[2])[kinds] - parts[2][kinds]
    return parts[0][kinds], parts[1][np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def cut(codes: np.ndarray, first: np.ndarray, left: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) tokens from each `first` on, `left` of them at most; -1 after the last one."""
    out = np.full((len(first), WINDOW), -1, np.int32)
    for t in range(WINDOW):
        some = left > t
        out[some, t] = codes[first[some] + t]
    return out


def windows(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) tokens, -1 after a text's last one, and how many windows each text has (one at least)."""
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)) * STRIDE
    return cut(codes, np.cumsum([0, *sizes[:-1]])[owner] + start, (sizes[owner] - start).clip(max=WINDOW)), counts


def closer(sizes: np.ndarray, counts: np.ndarray, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts whose strongest window (the first of equal ones) reaches LOOK_AGAIN, and the starts of all windows at
    steps of FINE that overlap it by more than the next ones do."""
    ends = np.cumsum(counts)
    best = np.maximum.reduceat(logits, ends - counts)
    text, start = [], []
    for k in np.flatnonzero((best >= LOOK_AGAIN) & (sizes > WINDOW)).tolist():
        at = int(np.argmax(np.round(logits[ends[k] - counts[k] : ends[k]], 3))) * STRIDE
        around = np.arange(max(0, at - STRIDE + FINE), min(int(sizes[k]) - WINDOW, at + STRIDE - FINE) + 1)
        around = around[(around - at) % FINE == 0]
        text.append(np.full(len(around), k))
        start.append(around)
    return np.concatenate([np.empty(0, np.int64), *text]), np.concatenate([np.empty(0, np.int64), *start])


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in turn, of at most TOGETHER bytes (a text more at most)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + TOGETHER, "right")))
        yield texts.slice(i, j - i)
        i = j


class Scorer:
    """Scores documents; remembers the inputs of tokens up to a bound (one slice's tokens, if these are more)."""

    def __init__(self, model: Model, kept: int = 150_000):
        self.m, self.kept = model, kept
        self.clear()

    def clear(self, least: int = 0) -> None:
        """Room for so many tokens at least. A last row stays empty: no token."""
        self.kinds: dict[str, int] = {}
        self.table = tuple(np.zeros((max(self.kept, least) + 1, 3 * H), np.float32) for _ in "fb")  # takes memory as it fills

    def fits(self, kinds: list[str]) -> bool:
        return len(self.kinds) + sum(k not in self.kinds for k in kinds) < len(self.table[0])

    def rows(self, kinds: list[str]) -> np.ndarray:
        """Rows of the table for different tokens, which fit it."""
        at, old = self.kinds, len(self.kinds)
        out = np.fromiter((at.setdefault(k, len(at)) for k in kinds), np.int32, len(kinds))
        fresh = [k for k, i in zip(kinds, out.tolist(), strict=True) if i >= old]
        for i, j in spans(fresh):  # some at a time: n-grams are many
            for t, x in zip(self.table, self.m.inputs(*self.m.lookup(fresh[i:j])), strict=True):
                t[old + i : old + j] = x[:-1]
        return out

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens, as rows of the table, and sizes of some texts after others, as long as the table holds their rows."""
        held, tokens = [], 0
        for some in slices(texts):
            kinds, codes, sizes = coded(some)
            if not (fits := self.fits(kinds)) or tokens + len(codes) > TOKENS:
                if held:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, tokens = [], 0
                if not fits:
                    self.clear(len(kinds))
            held.append((self.rows(kinds)[codes], sizes))
            tokens += len(codes)
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self.best(*x) for x in self.read(texts))])

    def best(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ids, counts = windows(codes, sizes)
        logits = self.m.window_logits(self.table, ids)
        best = np.maximum.reduceat(logits, np.cumsum([0, *counts[:-1]]))
        text, start = closer(sizes, counts, logits)
        if len(text):
            first = np.cumsum([0, *sizes[:-1]])
            np.maximum.at(best, text, self.m.window_logits(self.table, cut(codes, first[text] + start, np.full(len(text), WINDOW))))
        return best


def log_odds(one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Of frequencies, from -1 to 1; a few documents say little."""
    return np.clip(np.log(one + 4 / n) - np.log(other + 4 / n), -3, 3) / 3


def gram_counts(names: list[str], seen: np.ndarray) -> np.ndarray:
    """Documents for each n-gram hash and label; a token's documents count for all its n-grams."""
    out = np.zeros((2, GRAMS))
    for i in range(0, len(names), SOME):
        flat, sizes = grams(names[i : i + SOME], GRAM_BITS)
        for y in (0, 1):
            out[y] += np.bincount(flat, np.repeat(seen[y, i : i + SOME], sizes), GRAMS)
    return out


def train(texts: list[str | None], labels: list[int], epochs: int = 5, steps: int = 200, rate: float = 0.01, seed: int = 0) -> Model:
    """At least so many epochs, and so many steps of 64 documents."""
    if len(set(labels)) < 2:
        model = Model({}, seed)
        model.p["out"][:] = 0
        model.p["bias"][:] = np.log((1 + sum(map(int, labels))) / (2 + len(labels) - sum(map(int, labels))))
        return model
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    kinds, codes, sizes = coded(pa.array(texts, pa.string()))
    codes = codes.astype(np.int32)
    give_back()
    names: dict[str, int] = {}
    of = np.fromiter((names.setdefault(normal(k), len(names)) for k in kinds), np.int32, len(kinds))
    seen = np.zeros((2, len(names)))  # documents of each label with a normal token
    for part, label in zip(np.split(codes, np.cumsum(sizes)[:-1]), labels, strict=True):
        seen[int(label), np.unique(of[part])] += 1
    words = sorted(w for w, k in names.items() if seen[:, k].sum() >= 2)
    model = Model({w: i + 1 for i, w in enumerate(words)}, seed)
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    if words:  # how much more often toxic documents have a word: where learning starts
        few = seen[:, [names[w] for w in words]]
        model.p["word"][1:, 0] = log_odds(few[1] / n1, few[0] / n0, n0 + n1)
        clean, toxic = gram_counts(list(names), seen)
        model.p["char"][:, 0] = log_odds(toxic / n1, clean / n0, n0 + n1)
        del few, clean, toxic
    del words, names, seen, of
    parts = model.lookup(kinds)
    every, counts = windows(codes, sizes)
    wins = np.split(every, np.cumsum(counts)[:-1])
    del kinds, codes
    give_back()
    table = None
    epochs = max(epochs, -(-steps // -(-len(y) // 64)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        speed = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            if i % 512 == 0:  # the strongest windows are looked for with the weights of some steps ago
                del table  # a table is as large as all else: never two at once
                near = np.unique(np.concatenate([wins[k] for k in order[i : i + 512]]))
                near = near[near >= 0]
                table = model.inputs(*parts_of(parts, near))
            ids = np.concatenate([wins[k] for k in some])
            whose = np.repeat(np.arange(len(some)), [len(wins[k]) for k in some])
            logit = model.window_logits(table, np.where(ids < 0, -1, np.searchsorted(near, ids)))
            best = np.lexsort((-logit, whose))
            best = best[np.r_[True, np.diff(whose[best]) > 0]]
            model.step(ids[best], parts, y[some], speed)
    model.moment = {}
    return model


#: Characters of the sample's texts of a label, at most.
SAMPLE_CHARS = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, text, y of at most most[y] documents of label y, none of them held out. One row of each id. Of the
    documents of a label, in order of hash, those stay whose texts have at most `chars` characters together."""
    ids = labels.where(~held_out() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = [ids.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k]) for k in (0, 1)]
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample
    chosen = some[0].unionByName(some[1])  # at most sum(most) rows: a bound for the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("upto", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(so_far)).where(F.col("upto") <= chars).select("doc_id", "text", "y")


def fit(sample: DataFrame, train: Callable):
    """What `train` makes of the sample's texts and labels, in one task: the sample is bounded, and the driver
    gets nothing but the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["doc_id"]))
        model = train([r.pop("text") for r in rows], [r["y"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        del rows, model
        give_back()

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else train([], [])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (2400, 800), model: Model | None = None, out: str = "toxicity") -> DataFrame:
    """`docs` with toxicity (0 to 1) and toxicity_logit, or what `out` calls them."""
    spark = docs.sparkSession
    small_batches(spark, 2048)
    if model is None:
        model = fit(labelled_sample(docs, labels, "toxic", sample), train)
    sent = spark.sparkContext.broadcast(model)  # at most some megabytes: the sample bounds the vocabulary
    names = [c for c in docs.columns if c.lower() not in (out, f"{out}_logit")]
    schema = docs.select(*[f"`{c}`" for c in names], F.lit(0.0).alias(out), F.lit(0.0).alias(f"{out}_logit")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for b in in_utc(batches):
            logit = np.round(score(b.column("text")).astype(np.float64), 4)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sigmoid(logit)), pa.array(logit)], schema.names)
        give_back()

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
