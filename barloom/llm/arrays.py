"""Numpy helpers for tasks: 64-bit mixing and sorted streams of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's last step)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def columns(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """One array of the columns' values together."""
    out = np.empty(b.num_rows, [(n, np.int64) for n in names])
    for n in names:
        out[n] = column(b, n)
    return out


def in_utc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Timestamps that pass through carry the session's time zone; what is returned must say UTC."""
    for b in batches:
        yield b.cast(pa.schema([pa.field(f.name, pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f for f in b.schema]))


def give_back() -> None:
    """Returns freed memory to the system, as a Python process stays until its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def several(batches: Iterator[pa.RecordBatch], key: str | list[str], members: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """From batches sorted by key and members: for each key with two or more different members, its
    members but the first, with that first one. Yields key, first members, other members; holds one batch."""
    last = None  # key, first member, latest member
    for b in batches:
        if not b.num_rows:
            continue
        k, ms = column(b, key) if isinstance(key, str) else columns(b, key), [column(b, m) for m in members]
        if last is not None:
            k, ms = np.concatenate([last[0], last[0], k]), [np.concatenate([f, x, m]) for f, x, m in zip(last[1], last[2], ms, strict=True)]
        new = np.r_[True, k[1:] != k[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        other = np.zeros(len(k), bool)
        fresh = new.copy()
        for m in ms:
            other |= m != m[first]
            fresh[1:] |= m[1:] != m[:-1]
        got = other & fresh
        if last is not None:
            got[:2] = False
        if got.any():
            yield k[got], [m[first[got]] for m in ms], [m[got] for m in ms]
        i = first[-1]
        last = k[-1:], [m[i : i + 1] for m in ms], [m[-1:] for m in ms]
