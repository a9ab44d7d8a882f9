r"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that starts more than once.

Bucket-pointer refinement: positions stand in buckets by their first q bytes; a bucket is refined by sorting it on
the bucket pointers of the positions q bytes further on, and the pointers that this updates serve the next step, so
8 bytes become 16, 32, 64, 128 and at last `length`. A bucket of one position is final and sorted no more. Pointers
are ranks, not hashes: equal ones mean equal bytes.

Over the cluster, only what can repeat is refined. Every window of `length` bytes is represented by one of its
64-byte positions (that with the least hash; equal windows choose alike). These initial buckets (about 1.5 in 100
positions) are formed by a shuffle; a window whose representative has no company cannot repeat. The others are
sent, with the bytes of their windows, to the task of their bucket, which refines it.

Where a hash decides: windows of text that repeats itself within 64 bytes (they have no single representative) go by a
64-bit hash of all their bytes; windows that meet across the pieces of a bucket of BIG rows or more, by 128 bits.
All other equality is of bytes. Texts are named by a 64-bit hash and their length; SHA-256 of all texts shows whether
two have one name, and then names are drawn again.

Copies of a whole document count once in that sort (any copy of at least `length` bytes is removed
whole, as each of its windows starts elsewhere, too). Matches never cross documents; what is removed
is judged on the input.

Nulls: a null text is empty. Empty and short texts lose nothing. Repeated rows are copies. Other columns are not
read. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, column, mix, texts
from .common import forget, keep, small_batches

SEED = 64  # bytes of a representative
#: Bytes of texts, or of windows, that a task refines at once.
CHUNK = 1 << 18
#: Spans of so many bytes (about 120 for each text and 8 for each span) are broadcast; more go through a shuffle join.
BROADCAST_BYTES = 32 << 20
#: Rows of a bucket from which it is dealt over several tasks.
BIG = 4096
K = U(0x9E3779B97F4A7C15)


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of `length` bytes inside items (which begin at starts; the last entry is the end),
    and the bucket of each: equal numbers for equal windows. By bucket-pointer refinement."""
    n = len(data)
    p = np.arange(n)
    item = np.searchsorted(starts, p, "right") - 1
    windows = np.flatnonzero(p + length <= starts[item + 1])
    if not len(windows):
        return windows, windows
    first = np.zeros(n, np.uint64)  # the first 8 bytes of each position, as a number
    wide = np.r_[data, np.zeros(8, np.uint8)]
    for i in range(8):
        first = first << U(8) | wide[i : n + i]
    pointer, active, q = np.zeros(n, np.int64), p, 0

    def refined(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the positions of each bucket by key. New pointers: where the parts of a bucket begin; and which parts have company."""
        order = np.argsort((pointer[at].astype(np.uint64) << U(32)) | key if q else key)
        bucket, key = pointer[at][order], key[order]
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        part = new | np.r_[True, key[1:] != key[:-1]]
        rank = np.arange(len(at))
        begins = lambda x: np.maximum.accumulate(np.where(x, rank, 0))
        out, company = np.empty(len(at), np.int64), np.empty(len(at), bool)
        out[order] = bucket + begins(part) - begins(new)
        company[order] = ~(part & np.r_[part[1:], True])
        return out, company

    pointer, company = refined(p, first)
    active, q = p[company], 8
    while 2 * q <= length:
        some = active[active + q < n]
        moved, company = refined(some, pointer[some + q].astype(np.uint64))
        pointer[some] = moved  # at once: all keys of this step were of q bytes
        active, q = some[company], 2 * q
    if q < length:  # windows alone: the last two strings of q bytes overlap
        moved, _ = refined(windows, pointer[windows + length - q].astype(np.uint64))
        return windows, moved
    return windows, pointer[windows]


def refine(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the strings of each size at each position, doubled like buckets (sizes rise; 64 or more)."""
    ids = b.astype(np.uint64)
    for q in (1, 2, 4):
        ids = ids[:-q] | ids[q:] << U(8 * q)
    out, q = [], 8
    for size in sizes:
        while 2 * q <= size:
            ids = mix(ids[:-q] * K + ids[q:])
            q *= 2
        out.append(mix(ids[: len(ids) - (size - q)] * K + ids[size - q :]) if size > q else ids)
    return out


def chunks(items: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Indices of items, their bytes one after another, and where each starts (and the last ends)."""
    some, total = [], 0
    for i, x in enumerate(items):
        some.append(i)
        total += len(x)
        if total >= CHUNK or i == len(items) - 1:
            yield some, np.frombuffer(b"".join([items[j] for j in some]), np.uint8), np.cumsum([0, *[len(items[j]) for j in some]])
            some, total = [], 0


NONE = tuple(np.empty(0, np.int64) for _ in range(5))


def representatives(b: np.ndarray, starts: np.ndarray, length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of the windows whose representative is the only position in them with its (shortened) identifier: item,
    position, identifier, first and last window of each run of windows with one representative. Of the other
    windows, which lie in text that repeats itself at once: item, window, identifier of all its bytes.
    Positions count from the item's start."""
    if len(b) < length:
        return NONE, NONE[:3]
    ids, whole = refine(b, (SEED, length))
    width = length - SEED + 1
    bits = max(1, int(len(ids)).bit_length())
    place = np.arange(len(ids), dtype=np.uint64)
    high = (ids >> U(bits)) << U(bits)
    low = U((1 << bits) - 1)

    def least(x: np.ndarray) -> np.ndarray:
        w = 1
        while 2 * w <= width:
            x = np.minimum(x[:-w], x[w:])
            w *= 2
        return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if w < width else x

    best, back = (least(high | place) & low).astype(np.int64), (low - (least(high | low - place) & low)).astype(np.int64)
    p = np.arange(len(best))
    item = np.searchsorted(starts, p, "right") - 1
    ok = p + length <= starts[item + 1]
    once = ok & (best == back)
    tied = np.flatnonzero(ok & (best != back))
    ties = item[tied], tied - starts[item[tied]], whole[tied].view(np.int64)
    p, best, item = p[once], best[once], item[once]
    if not len(p):
        return NONE, ties
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.r_[new[1:], len(p)] - 1
    item, at = item[new], best[new]
    return (item, at - starts[item], ids[at].view(np.int64), p[new] - starts[item], p[last] - starts[item]), ties


def _local(item: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For names within items: the first two rows of each (item, name), and which rows have another like them."""
    order = np.lexsort((name, item))
    i, n = item[order], name[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (n[1:] != n[:-1])] if len(order) else np.empty(0, bool)
    second = np.r_[False, new[:-1]] & ~new if len(order) else new
    twin = np.zeros(len(order), bool)
    twin[order] = ~new | np.r_[~new[1:], False] if len(order) else twin
    return order[new | second], twin


#: Sets keys of whole windows apart from those of representatives.
APART = np.int64(0x5851F42D4C957F2D)


def _seeds(docs: DataFrame, length: int) -> DataFrame:
    """key, text_id, n, pos: the representatives of each different text (a task gives each once). Windows without
    one are their own, by the identifier of all their bytes, and have -1 - pos; of equal ones in a text two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            own, ns, items = column(b, "text_id"), column(b, "n"), []
            for k, n, t in zip(own.tolist(), ns.tolist(), texts(b.column("text")), strict=True):
                items.append(t if (k, n) not in seen else b"")
                seen.add((k, n))
            for some, data, starts in chunks(items):
                (item, pos, key, _, _), (t_item, t_pos, t_name) = representatives(data, starts, length)
                two, _ = _local(t_item, t_name)
                row = np.array(some)[np.r_[item, t_item[two]].astype(np.int64)]
                key, pos = np.r_[key, t_name[two] ^ APART], np.r_[pos, -1 - t_pos[two]]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(own[row]), pa.array(ns[row].astype(np.int32)), pa.array(pos.astype(np.int32))], ["key", "text_id", "n", "pos"])

    return docs.where(F.col("n") >= length).select("text_id", "n", "text").mapInArrow(run, "key long, text_id long, n int, pos int")


def _meeting(seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """text_id, n, pos of the representatives in buckets (of a key, or of key and key2) of two or more (some several
    times), the buckets (keys, rows), and the kept representatives. Which buckets have company comes from partial aggregation, so a bucket that
    holds most rows is counted everywhere; its rows are then found by a semi join, whose skew Spark splits."""
    keys = [c for c in ("key", "key2") if c in seeds.columns]
    seeds = keep(seeds, "representatives")
    ends = [f(c).alias(f"{c}_{k}") for c in ("text_id", "n", "pos") for k, f in (("low", F.min), ("high", F.max))]
    buckets = seeds.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *ends).where("text_id_low <> text_id_high or n_low <> n_high or pos_low <> pos_high")
    buckets = keep(buckets.select(*keys, "rows"), "buckets")
    return seeds.join(_sized(buckets.select(*keys), F.lit(24)), keys, "left_semi").select("text_id", "n", "pos"), buckets, seeds


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """key, text_id, n, start, bytes, to: for each marked representative, the bytes of its windows (to is null); for
    windows that are already known to repeat, no bytes, but where they end."""

    def marked(wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return np.zeros(len(at), bool)
        return wanted[np.searchsorted(wanted, at).clip(max=len(wanted) - 1)] == at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ns, marks, items = column(b, "text_id"), column(b, "n"), b.column("marks").to_pylist(), texts(b.column("text"))
            for some, data, starts in chunks(items):
                (item, pos, key, first, last), (t_item, t_pos, t_name) = representatives(data, starts, length)
                all_marks = np.concatenate([np.array(marks[i], np.int64) for i in some])
                owner = np.repeat(np.arange(len(some)), [len(marks[i]) for i in some])
                plain = all_marks >= 0
                ok = marked(np.sort(all_marks[plain] + starts[owner[plain]]), pos + starts[item])
                hit = marked(np.sort(-1 - all_marks[~plain] + starts[owner[~plain]]), t_pos + starts[t_item])
                _, twin = _local(t_item, t_name)
                known = np.unique(np.stack([t_item[hit], t_name[hit]], 1), axis=0) if hit.any() else np.empty((0, 2), np.int64)
                if len(known):  # every window that is like a marked one, in the same text
                    both = np.r_[known, np.stack([t_item, t_name], 1)]
                    _, code = np.unique(both, axis=0, return_inverse=True)
                    hit = np.isin(code.reshape(-1)[len(known) :], code.reshape(-1)[: len(known)])
                hit |= twin
                t_item, t_pos = t_item[hit], t_pos[hit]
                new = np.flatnonzero(np.r_[True, (t_item[1:] != t_item[:-1]) | (t_pos[1:] != t_pos[:-1] + 1)]) if len(t_item) else np.empty(0, np.int64)
                end = np.r_[new[1:], len(t_item)] - 1 if len(new) else new
                row, t_row = np.array(some)[item[ok]], np.array(some)[t_item[new]]
                got = [items[r][f : z + length] for r, f, z in zip(row.tolist(), first[ok].tolist(), last[ok].tolist(), strict=True)]
                rows = np.r_[row, t_row].astype(np.int64)
                start = np.r_[first[ok], t_pos[new]].astype(np.int32)
                to = np.r_[np.zeros(len(row)), t_pos[end] + length].astype(np.int32)
                keys = np.r_[key[ok], mix(np.arange(len(t_row), dtype=np.uint64)).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(own[rows]), pa.array(ns[rows].astype(np.int32)), pa.array(start), pa.array([*got, *[None] * len(t_row)], pa.binary()), pa.array(to, mask=np.arange(len(to)) < len(row))], ["key", "text_id", "n", "start", "bytes", "to"])

    return docs.select("text_id", "n", "text", "marks").mapInArrow(run, "key long, text_id long, n int, start int, bytes binary, to int")


def _spans(windows: DataFrame, length: int, shards: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """text_id, n, from, to: bytes covered by windows that start more than once; and the tables kept for it.

    shards: key, shards of the buckets that one task should not hold. Their texts are dealt over so many tasks, which
    refine them in pieces: what repeats in a piece is settled there, and one window of each identifier goes on to meet
    those of the other pieces."""

    def repeated(rows: list[tuple], piece: bool = False) -> pa.RecordBatch:
        # Rows of equal bytes repeat whole, and one of them is refined. The windows of one row differ (they hold their
        # representative at different places), so a bucket of one such row is final.
        seen: dict[bytes, int] = {}
        twin = np.zeros(len(rows), bool)
        for k, row in enumerate(rows):
            if (j := seen.setdefault(row[4], k)) != k:
                twin[[j, k]] = True
        alone = Counter(rows[k][0] for k in seen.values())
        some = np.array([k for k in seen.values() if piece or alone[rows[k][0]] > 1], np.int64)
        data, starts = np.frombuffer(b"".join([rows[k][4] for k in some]), np.uint8), np.cumsum([0, *[len(rows[k][4]) for k in some]])
        p, bucket = repeated_windows(data, starts, length)
        whose = np.searchsorted(starts, p, "right") - 1
        at = p - starts[whose]
        whose = some[whose]
        order = np.argsort(bucket, kind="stable")
        same = np.r_[False, bucket[order][1:] == bucket[order][:-1]] if len(order) else np.empty(0, bool)
        hit = np.zeros(len(p), bool)
        hit[order] = same | np.r_[same[1:], False] if len(order) else same
        hit &= ~twin[whose]
        one = order[~same] if piece else order[:0]
        one_row, one_at, one_p = whose[one], at[one], p[one]
        whose, at = whose[hit], at[hit]
        new = np.flatnonzero(np.r_[True, (whose[1:] != whose[:-1]) | (at[1:] != at[:-1] + 1)]) if len(whose) else np.empty(0, np.int64)
        last = np.r_[new[1:], len(whose)] - 1 if len(new) else new
        full = np.flatnonzero(twin)
        wide = np.array([len(x[4]) for x in rows], np.int64)[full] - length
        r = np.r_[full, whose[new], one_row].astype(np.int64)
        col = lambda k, t: np.array([x[k] for x in rows], t)[r]
        start = col(3, np.int64)
        cols = [col(1, np.int64), col(2, np.int32), (start + np.r_[0 * full, at[new], one_at]).astype(np.int32), (start + np.r_[wide, at[last], one_at] + length).astype(np.int32)]
        known = len(full) + len(new)
        names = ["text_id", "n", "from", "to"]
        if piece:
            for name, b in (("name", data), ("name2", mix(data + U(7)))):
                of = refine(b, (length,))[0].view(np.int64)[one_p] if len(one_p) else np.empty(0, np.int64)
                cols.append(pa.array(np.r_[np.zeros(known, np.int64), of], mask=np.arange(len(r)) < known))
                names.append(name)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:4] == last:  # another task's copy of the same text
                    continue
                if held >= 4 * CHUNK:
                    yield repeated(rows, True)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
                last = r[:4]
        if rows:
            yield repeated(rows, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for b in batches:
            known = b.filter(b.column("to").is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in ("text_id", "n", "start", "to")], ["text_id", "n", "from", "to"])
            b = b.filter(b.column("to").is_null()).select(["key", "text_id", "n", "start", "bytes"])
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:4] == last:  # another task's copy of the same text
                    continue
                if held >= 4 * CHUNK and r[0] != last[0]:
                    yield repeated(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
                last = r[:4]
        if rows:
            yield repeated(rows)

    schema, order = "text_id long, n int, from int, to int", ["key", "text_id", "n", "start"]
    if shards is None:
        return windows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema), []
    w = keep(windows.join(_sized(shards, F.lit(24)), "key", "left"), "windows")
    small = w.where("shards is null or `to` is not null").drop("shards").repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema)
    large = w.where("shards is not null and `to` is null").withColumn("shard", F.pmod(F.xxhash64("text_id"), "shards")).repartition("key", "shard").sortWithinPartitions("key", "shard", *order[1:])
    found = keep(large.select(*order, "bytes").mapInArrow(pieces, f"{schema}, name long, name2 long"), "pieces")
    met, *tables = _meeting(found.where("name is not null").select(F.col("name").alias("key"), F.col("name2").alias("key2"), "text_id", "n", F.col("from").alias("pos")))
    return small.unionByName(found.where("name is null").drop("name", "name2")).unionByName(met.select("text_id", "n", F.col("pos").alias("from"), (F.col("pos") + length).cast("int").alias("to"))), [w, found, *tables]


def _merged(spans: DataFrame) -> DataFrame:
    """text_id, n, froms, tos: the maximal runs of a text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            froms, tos = [], []
            for spans_ in b.column("spans").to_pylist():
                a = np.array(sorted((x["from"], x["to"]) for x in spans_), np.int32).reshape(-1, 2)
                ends = np.maximum.accumulate(a[:, 1])
                new = np.r_[True, a[1:, 0] > ends[:-1]]
                froms.append(a[new, 0])
                tos.append(ends[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]])
            yield pa.RecordBatch.from_arrays([b.column("text_id"), b.column("n"), pa.array(froms, pa.list_(pa.int32())), pa.array(tos, pa.list_(pa.int32()))], ["text_id", "n", "froms", "tos"])

    grouped = spans.groupBy("text_id", "n").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return grouped.mapInArrow(run, "text_id long, n int, froms array<int>, tos array<int>")


def _sized(parts: DataFrame, weight) -> DataFrame:
    """`parts`, marked for broadcast if its rows weigh few enough bytes."""
    return F.broadcast(parts) if (parts.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES else parts


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_id, n: no two different texts share text_id and n."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("n"))
    seed = 0
    while True:
        named = d.withColumn("text_id", F.xxhash64(F.lit(seed), "text"))
        sha = named.groupBy("text_id", "n").agg(F.min(F.sha2(F.col("text").cast("binary"), 256)).alias("low"), F.max(F.sha2(F.col("text").cast("binary"), 256)).alias("high"))
        if sha.where("low <> high").isEmpty():
            return named
        seed += 1


def repeated_spans(docs: DataFrame, length: int = 200, big: int = BIG) -> DataFrame:
    """text_id, n, froms, tos: what is removed from each text that loses something. docs: see _named."""
    d = docs
    small_batches(docs.sparkSession, 256)
    met, buckets, seeds = _meeting(_seeds(d, length))
    marks = keep(met.groupBy("text_id", "n").agg(F.collect_set("pos").alias("marks")), "marks")
    shards = buckets.where(F.col("rows") >= big).select("key", F.expr(f"cast(rows div {big} + 1 as int)").alias("shards"))
    windows = _windows(d.join(marks, ["text_id", "n"]), length)
    forget(seeds)
    spans, tables = _spans(windows, length, None if shards.isEmpty() else shards)
    parts = keep(_merged(spans), "spans")
    forget(buckets, *tables)
    parts = parts.withColumn("copies", F.lit(0).cast("long"))
    none = F.array().cast("array<int>")
    copies = d.where(F.col("n") >= length).groupBy("text_id", "n").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("text_id", "n", none.alias("froms"), none.alias("tos"), "copies")
    both = parts.unionByName(copies).groupBy("text_id", "n").agg(F.max("copies").alias("copies"), F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos"))
    whole = F.col("copies") > 1
    out = keep(both.select("text_id", "n", F.when(whole, F.array(F.lit(0))).otherwise(F.col("froms")).alias("froms"), F.when(whole, F.array("n")).otherwise(F.col("tos")).alias("tos")), "removed")
    forget(marks, parts)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, big: int = BIG) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, froms, tos for every row of `docs`."""
    named = _named(docs)
    spans = repeated_spans(named, length, big)
    d = named.join(_sized(spans, F.lit(120) + 8 * F.size("froms")), ["text_id", "n"], "left").select("doc_id", "n", "text", "froms", "tos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone = [], []
            for t, f, z in zip(texts(b.column("text")), b.column("froms").to_pylist(), b.column("tos").to_pylist(), strict=True):
                f, z = f or [], z or []
                kept.append(b"".join([t[i:j] for i, j in zip([0, *z], [*f, len(t)], strict=True)]) if f else t)
                gone.append(sum(z) - sum(f))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            count = pa.array([len(f or ()) for f in b.column("froms").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n").cast(pa.int64()), pa.array(gone, pa.int64()), count, pa.array(kept, pa.binary()), pa.array(sha), b.column("froms"), b.column("tos")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "froms", "tos"])

    return d.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, froms array<int>, tos array<int>")
