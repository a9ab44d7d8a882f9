"""Tokens of many texts at once, by Arrow: each different token is looked at once a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs of characters longer than this are read as several tokens (this bounds a task's memory). They overlap by
#: one character less than the longest n-gram, so no n-gram is lost.
LONGEST, OVERLAP = 4096, 5
#: Tokens, and characters (a token more at most), whose n-grams are made at once.
SOME, CHARS = 20_000, 400_000


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different tokens (what white space separates), the number of each text's tokens in turn, and how
    many tokens each text has. A null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    kinds, codes = flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64)
    if "" in kinds:  # of texts without tokens
        empty = kinds.index("")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes - np.bincount(owner[codes == empty], minlength=len(sizes))
        codes = codes[codes != empty]
    starts = [range(0, max(1, len(k) - OVERLAP), LONGEST - OVERLAP) if len(k) > LONGEST else range(1) for k in kinds]
    pieces = np.array([len(x) for x in starts], np.int64)
    if len(kinds) and pieces.max() > 1:
        first = np.cumsum([0, *pieces[:-1]])
        kinds = [k[i : i + LONGEST] for k, x in zip(kinds, starts, strict=True) for i in x]
        n = pieces[codes]
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        codes = np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        sizes = np.bincount(owner, weights=n, minlength=len(sizes)).astype(np.int64)
        once: dict[str, int] = {}  # a piece may be another token
        codes = np.array([once.setdefault(k, len(once)) for k in kinds], np.int64)[codes]
        kinds = list(once)
    return kinds, codes, sizes


def spans(kinds: list[str]) -> list[tuple[int, int]]:
    """Where to cut tokens, so that each part has at most SOME of them and CHARS characters (a token more at most)."""
    cuts, chars = [0], 0
    for i, k in enumerate(kinds):
        chars += len(k)
        if i + 1 - cuts[-1] == SOME or chars >= CHARS:
            cuts.append(i + 1)
            chars = 0
    cuts.append(len(kinds))
    return [(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def grams(kinds: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (of `bits` bits) of the 3- to 6-grams of the characters of each (marked) token, one after
    another, and how many each has."""
    parts = [_grams(kinds[i:j], bits) for i, j in spans(kinds)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _grams(kinds: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    data = [f"<{k}>" for k in kinds]
    sizes = np.array([len(x) for x in data])
    b = np.frombuffer("".join(data).encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.r_[b, np.zeros(6, np.uint32)]
    left = np.repeat(sizes, sizes) - (np.arange(len(b) - 6) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes))
    h, hs, ok = np.zeros(len(left), np.uint32), np.empty((len(left), 4), np.int32), np.empty((len(left), 4), bool)
    for n in range(6):
        h = (h ^ b[n : n + len(left)]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        if n >= 2:
            hs[:, n - 2] = (h * np.uint32(2246822519)) >> np.uint32(32 - bits)
            ok[:, n - 2] = left > n
    ok[left == 2, 0] = sizes[np.repeat(np.arange(len(sizes)), sizes)[left == 2]] == 2  # an empty token has one
    count = np.add.reduceat(ok.sum(1), np.cumsum([0, *sizes[:-1]])) if len(sizes) else np.empty(0, np.int64)
    return hs[ok], count
