"""Conversation prefix trie by minimal-perfect-hash node tables.

A node is a distinct sequence of first turns; its digest is the exclusive or of a 128-bit hash of every (depth, turn),
so a prefix's parent is its own digest without its last turn, and prefixes come from running aggregates.
Conversations are cut into segments of SEGMENT turns, and segments are dealt to shards by hash. A shard enumerates its
distinct prefix digests, gives each a slot by a minimal perfect hash (the whole digest, parent, depth and length are
compared in the slot), scatters counts into flat arrays, and adds up subtrees through parent slots from the deepest
depth to the top. All sums are linear: a node's own share is scattered once, in the shard of its smallest member,
whose path holds all ancestors; shards' partial sums of a node are then added by Spark. So a first turn, or a
conversation, that a third of all rows share costs a row per shard, and nothing travels whole to one task.

Nulls: a null role or text is empty; null turns come first; rows without conv_id belong to no conversation. Rows of
one conversation with equal turns go by the hash of role and text; repeated rows are turns of their own. No
conversations: no nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U, mix
from .common import forget, keep

#: Turns of a conversation that are one unit of work, and rows of a shard (about 20 MB of arrays).
SEGMENT, SHARD_ROWS = 1024, 200_000
#: Ends of a node are packed by so many consecutive conv_ids (a power of two) before they are hashed in order.
PACK_BITS = 12
KEY = ["p1", "p2"]


# -- turns in order


def steps_of(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), h1, h2 (of role and text), n_bytes (of the text). Ranks come from counts per block of
    turn numbers plus ranks within a block, so a long conversation is no single group."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.shiftright(F.col("turn").cast("long"), 10), F.lit(-(1 << 62))).alias("block"), "turn",
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    line = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2"))
    return d.withColumn("rank", rank).join(before, ["conv_id", "block"]).select("conv_id", (F.col("before") + F.col("rank")).alias("depth"), "h1", "h2", "n_bytes")


def lengths(steps: DataFrame) -> DataFrame:
    """conv_id, n: turns of each conversation."""
    return steps.groupBy("conv_id").agg(F.max("depth").alias("n"))


def share_heads(steps: DataFrame, convs: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Steps of rebuilt conversations: conv_id c starts with the first h turns of conversation c - c % family (h is
    crc32 of the decimal id modulo `heads`), and goes on with its own turns after its first h."""
    c = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    c = c.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    first = steps.where(F.col("depth") < heads).withColumnRenamed("conv_id", "base")
    given = c.join(first, "base").where("depth <= h").select(*steps.columns)
    lent = F.least("h", F.coalesce("n_base", F.lit(0)))
    own = steps.join(c.select("conv_id", "h", lent.alias("lent")), "conv_id").where("depth > h").withColumn("depth", F.col("lent") + F.col("depth") - F.col("h"))
    return given.unionByName(own.select(*steps.columns))


# -- node tables


class NodeTable:
    """A minimal perfect hash of distinct 128-bit keys: keys that are alone in their place of a level's array stay
    there, the others try the next level; a slot is the rank of its place."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels, self.hi, self.lo = [], np.empty(len(hi), np.int64), np.empty(len(hi), np.int64)
        left, base = np.arange(len(hi)), 0
        while len(left):
            at = self._places(hi[left], lo[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, base - 1 + np.cumsum(alone)))
            base += int(alone.sum())
            left = left[~alone[at]]
        at = self._find(hi, lo)
        self.hi[at], self.lo[at] = hi, lo

    @staticmethod
    def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hi.view(U) ^ mix(lo.view(U) + U(level * 0x9E3779B97F4A7C15 % (1 << 64)))) % U(size)).astype(np.int64)

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for i, (alone, rank) in enumerate(self.levels):
            at = self._places(hi[left], lo[left], i, len(alone))
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        return out

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the slot holds another key or there is none."""
        at = self._find(hi, lo)
        if len(self.hi):
            at[(self.hi[at] != hi) | (self.lo[at] != lo)] = -1
        return at


def _table(p1: np.ndarray, p2: np.ndarray) -> NodeTable:
    order = np.lexsort((p2, p1))
    new = np.ones(len(order), bool)
    new[1:] = (p1[order[1:]] != p1[order[:-1]]) | (p2[order[1:]] != p2[order[:-1]])
    return NodeTable(p1[order[new]], p2[order[new]])


def _scattered(slot: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """One value per slot; rows of a slot must agree."""
    out = np.empty(size, np.int64)
    out[slot] = values
    if (out[slot] != values).any():
        raise ValueError("two different prefixes have one 128-bit digest")
    return out


NODES = "shard long, p1 long, p2 long, q1 long, q2 long, depth long, n_bytes long, conv_id long, n_convs long"
SUMS = "p1 long, p2 long, n_leaves long, saved_tokens long"


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t[c].to_numpy() for c in t.column_names}


def count_nodes(t: pa.Table) -> pa.Table:
    """Distinct prefixes of a shard with their members in it and the smallest of these."""
    a = _arrays(t)
    table = _table(a["p1"], a["p2"])
    slot, size = table.slots(a["p1"], a["p2"]), len(table.hi)
    same = {c: _scattered(slot, size, a[c]) for c in ("q1", "q2", "depth", "n_bytes")}
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, a["conv_id"])
    out = {"shard": np.full(size, a["shard"][0] if size else 0), "p1": table.hi, "p2": table.lo, **same, "conv_id": least, "n_convs": np.bincount(slot, minlength=size)}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def add_up(t: pa.Table) -> pa.Table:
    """Sums over the subtrees of a shard's prefixes. Rows with n_bytes are prefixes, the others bring shares."""
    a = _arrays(t)
    node = a["n_bytes"] >= 0
    table = _table(a["p1"][node], a["p2"][node])
    slot, size = table.slots(a["p1"], a["p2"]), len(table.hi)
    if (slot < 0).any():
        raise ValueError("a share without its prefix")
    q1, q2, depth = (_scattered(slot[node], size, a[c][node]) for c in ("q1", "q2", "depth"))
    parent = table.slots(q1, q2)
    parent[(depth == 0) | (depth > 1) & ((depth - 1) % SEGMENT == 0)] = -1  # the top of a segment: carried over by Spark
    sums = np.zeros((size, 2), np.int64)
    np.add.at(sums, slot, np.stack([a["n_leaves"], a["saved_tokens"]], 1))
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for same in np.split(order, cuts):
        same = same[parent[same] >= 0]
        np.add.at(sums, parent[same], sums[same])
    some = sums.any(1)
    out = {"p1": table.hi[some], "p2": table.lo[some], "n_leaves": sums[some, 0], "saved_tokens": sums[some, 1]}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the packed ids of each node, fed pack by pack from sorted rows."""
    key, h = None, None
    for b in batches:
        done: list[tuple[int, int, str]] = []
        for p1, p2, ids in zip(*[b.column(c).to_pylist() for c in ("p1", "p2", "ids")], strict=True):
            if (p1, p2) == key:
                h.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, h.hexdigest()))
            key, h = (p1, p2), hashlib.sha256(ids.encode())
        yield _ends(done)
    if key is not None:
        yield _ends([(*key, h.hexdigest())])


def _ends(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    p1, p2, ends = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(ends, pa.string())], names=["p1", "p2", "ends_sha256"])


# -- the trie


def _shard(shards: int, depth: str = "depth"):
    """Where the segment of conversation `conv_id` at that depth is counted; the root lies in the first segment."""
    seg = F.expr(f"greatest({depth} - 1, 0) div {SEGMENT}")
    return F.pmod(F.xxhash64("conv_id", seg), F.lit(shards)).alias("shard")


def _segments(steps: DataFrame) -> DataFrame:
    """conv_id, seg, x1, x2 (digest of its last prefix), b1, b2 (of the prefix before it), n (turns of the conversation)."""
    s = steps.groupBy("conv_id", "seg").agg(F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("conv_id")
    upto = every.orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select("conv_id", "seg", F.col("x1").alias("o1"), F.col("x2").alias("o2"), F.bit_xor("x1").over(upto).alias("x1"), F.bit_xor("x2").over(upto).alias("x2"), F.sum("n").over(every).alias("n"))
    return s.select("conv_id", "seg", "x1", "x2", F.col("x1").bitwiseXOR(F.col("o1")).alias("b1"), F.col("x2").bitwiseXOR(F.col("o2")).alias("b2"), "n")


def prefix_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of
    turns that a prefix cache need not read again, over the subtree), ends_sha256.

    steps: as of steps_of(). convs: conv_id of every conversation, those without turns included."""
    k1, k2 = F.xxhash64("depth", "h1", "h2").alias("k1"), F.xxhash64(F.lit(1), "depth", "h1", "h2").alias("k2")
    d = steps.select("conv_id", "depth", F.expr(f"(depth - 1) div {SEGMENT}").alias("seg"), "n_bytes", k1, k2)
    segments = keep(_segments(d), "segments")
    run = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"r1": F.bit_xor("k1").over(run), "r2": F.bit_xor("k2").over(run)}).join(segments, ["conv_id", "seg"])
    d = d.withColumns({"p1": F.col("b1").bitwiseXOR(F.col("r1")), "p2": F.col("b2").bitwiseXOR(F.col("r2"))})
    d = d.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("k1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("k2")).alias("q2"), "n_bytes", (F.col("depth") == F.col("n")).alias("last"))
    zero = F.lit(0).cast("long")
    turned = segments.where("seg = 0").select("conv_id", F.lit(True).alias("some"))
    roots = convs.select("conv_id").join(turned, "conv_id", "left").select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("p1", "p2", "q1", "q2", "n_bytes")], F.col("some").isNull().alias("last"))
    paths = keep(d.unionByName(roots), "paths")
    shards = max(1, math.ceil(paths.count() / SHARD_ROWS))
    tables = paths.select(_shard(shards), "p1", "p2", "q1", "q2", "depth", "n_bytes", "conv_id").groupBy("shard").applyInArrow(count_nodes, NODES)
    tables = keep(tables, "node-tables")
    nodes = tables.groupBy(*KEY).agg(*[F.any_value(c).alias(c) for c in ("q1", "q2", "depth", "n_bytes")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    found = keep(nodes, "nodes")
    children = found.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = keep(found.join(children, KEY, "left").na.fill(0, ["n_children"]), "nodes")
    forget(found)
    own = nodes.select("conv_id", "depth", *KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")).where("n_leaves + saved_tokens > 0")
    shares = own.select(_shard(shards), *KEY, "n_leaves", "saved_tokens")
    if (nodes.agg(F.max("depth")).first()[0] or 0) > SEGMENT:
        shares = shares.unionByName(_carried(own, segments).select(_shard(shards), *KEY, "n_leaves", "saved_tokens"))
    shares = shares.select("shard", *KEY, *[zero.alias(c) for c in ("q1", "q2", "depth")], F.lit(-1).cast("long").alias("n_bytes"), "n_leaves", "saved_tokens")
    rows = tables.select("shard", *KEY, "q1", "q2", "depth", "n_bytes", zero.alias("n_leaves"), zero.alias("saved_tokens")).unionByName(shares)
    sums = rows.groupBy("shard").applyInArrow(add_up, SUMS).groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = paths.where("last").groupBy(*KEY, F.shiftright("conv_id", PACK_BITS).alias("pack")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ends = ends.repartition(*KEY).sortWithinPartitions(*KEY, "pack").mapInArrow(hash_ends, "p1 long, p2 long, ends_sha256 string")
    out = keep(nodes.join(sums, KEY, "left").join(ends, KEY, "left").na.fill(0, ["n_leaves", "saved_tokens"]), "trie")
    forget(segments, paths, tables, nodes)
    parents = out.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    top = out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    got = out.where("depth > 0").join(parents, ["q1", "q2"]).unionByName(top)  # a parent with most children: split by adaptive execution
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _carried(own: DataFrame, segments: DataFrame) -> DataFrame:
    """What a conversation's later segments own, for the last prefix of each of its earlier segments."""
    later = own.where(F.col("depth") > SEGMENT).groupBy("conv_id", F.expr(f"(depth - 1) div {SEGMENT}").alias("seg")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    d = segments.where(F.col("n") > SEGMENT).join(later, ["conv_id", "seg"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("conv_id", ((F.col("seg") + 1) * SEGMENT).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), *[F.sum(c).over(after).alias(c) for c in ("n_leaves", "saved_tokens")])
    return d.where("n_leaves + saved_tokens > 0")


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt by share_heads()."""
    steps = keep(steps_of(turns), "steps")
    convs = keep(lengths(steps), "conversations")
    rebuilt = keep(share_heads(steps, convs), "rebuilt")
    out = prefix_trie(rebuilt, convs)
    forget(steps, convs, rebuilt)
    return out
