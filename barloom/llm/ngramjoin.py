r"""N-gram Jaccard join by a blocked sparse matrix product of documents by n-grams.

Rows of the incidence matrix are the different n-gram sets (copies share a row), columns the n-grams in
order of their hash. The product is taken in tiles of rows, one block of columns after another: overlap
counts add up, and between blocks a row drops out when the columns that are left cannot bring any of its
pairs to the bound that follows from the two sizes. A tile's counts never leave it; pairs that reach the
threshold do, as links, and links give components.

Which rows share a tile follows from two exact filters, which lose no pair above the threshold:

- Blocks. For each size class the columns are cut into more blocks than the symmetric difference of two
  sets above the threshold can touch, so such a pair agrees in at least one whole block. Rows that agree
  in a block meet in a shuffle on the block's content.
- Parity sketches. Each set toggles one of B bits per n-gram. Two sets differ in at least as many n-grams
  as their sketches differ in bits, so a pair whose sketches differ in more bits than its sizes allow is
  out. A few hundred bits move instead of a set.

First each row is multiplied with the first row of the block bucket that it shares in most blocks. Then only
what still lies in different components is compared: other first rows, and, in buckets of three or more rows,
all rows by their sketches, in tiles of bounded size. Pairs that a sketch cannot tell apart are multiplied;
where a tile has many, first each row's likeliest pair is, and rows that are then still apart are multiplied
as a whole and give as many links as join components. So no
group is expanded into its pairs, and no link between different texts is lost.

Within the join a set is known by a 64-bit hash (two sets with one hash would share one set's links); classes
of equal sets are told apart by 128 bits. N-grams are 64-bit hashes.

Nulls and empty texts: an empty set, linked with nothing. Texts with fewer words than an n-gram: one n-gram. Repeated rows
are copies. Rows without an id join components and get their smallest id (null where none has one). No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, WordHashes, column, give_back, mix, several, signed, texts
from .common import forget, keep, row_hash, small_batches

#: Up to so many ids are broadcast (about 40 bytes each); more go through a shuffle join.
BROADCAST_IDS = 1_000_000
#: Column blocks of a tile's product.
STEPS = 8
#: Rows and bytes of sets on each side of a tile; a column with more row pairs than LIGHT is multiplied densely, CHUNK columns at once.
TILE, TILE_BYTES, LIGHT, CHUNK = 1024, 16 << 20, 16, 2048
#: Pairs for each row of a tile from which its rows are multiplied as a whole.
DENSE = 1
#: Bits of a sketch for each n-gram in which two sets of its size may differ.
SKETCH = 8
NO_ID = -(1 << 63)


def ngram_set(text: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the different n-grams of the lower-cased words."""
    w = text.lower().split()  # of bytes: only A-Z are lowered, only \x20 and \x09-\x0D separate
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    s = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        s = mix(s) + h[i : len(h) - n + 1 + i]
    s = mix(s)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def set_ids(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


class Classes:
    """Size classes: in class i, sizes low[i] to high[i]; partners of the larger set lie in its class or
    the one below. blocks[i]: column blocks, so many that sets above the threshold agree in more
    blocks than `spare[i]` (0 blocks: only equal sets are above it)."""

    def __init__(self, percent: int, top: int = 1 << 40):
        self.low, self.high, self.blocks, self.spare = [], [], [], []
        low = 1
        while low <= top:
            high = low * 100 // percent
            differ = (100 - percent) * (200 * high // (100 + percent)) // 100
            spare = 1 + differ // 32
            self.low.append(low)
            self.high.append(high)
            self.spare.append(spare)
            self.blocks.append(differ + 1 + spare if differ else 0)
            low = high + 1

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1

    def keys(self, s: np.ndarray) -> list[np.ndarray]:
        """Keys of a set's blocks by content, in its own class and, as the smaller partner, the next."""
        out, i = [], self.of(len(s))
        spread = mix(s ^ U(0x9E3779B97F4A7C15))
        for c in (i, i + 1):
            if not (m := self.blocks[c]):
                continue
            part = ((s >> U(32)) * U(m)) >> U(32)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            total = np.add.reduceat(spread, at)
            part = part[at]
            if m - len(part) > self.spare[c]:  # many empty blocks: they count as content, too
                none = np.setdiff1d(np.arange(m, dtype=np.uint64), part)
                part, total = np.r_[part, none], np.r_[total, np.zeros(len(none), np.uint64)]
            out.append(mix(mix(total + U(c)) + part))
        return out


def needed(a, b, percent: int):
    """The least overlap of sets of a and b n-grams above the threshold: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(s: np.ndarray, percent: int) -> bytes:
    """Parities of the n-grams' low bits. Its length is a power of two, so a longer sketch folds into a shorter one."""
    bits = 64
    while bits < SKETCH * (2 * len(s) - 2 * needed(len(s), len(s), percent)):
        bits *= 2
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """(sketches, 64-bit words) of `size` bytes each; none is shorter."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    long = np.array([len(x) for x in sketches])
    for n in np.unique(long).tolist():
        rows = np.flatnonzero(long == n)
        x = np.frombuffer(b"".join([sketches[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), -1)
        out[rows] = np.bitwise_xor.reduce(x.reshape(len(rows), -1, size // 8), axis=1)
    return out


def may_reach(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of rows of folded sketches x, y of sets of a and b n-grams can be above the threshold."""
    need = needed(a, b, percent)
    return (np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= a + b - 2 * need) & (np.minimum(a, b) >= need)


def summaries(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """`docs` without text, with n_shingles, sid, sid2 and sketch: one row per row of docs."""
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("sid"), F.lit(0).cast("long").alias("sid2"), F.lit(b"").alias("sketch")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [ngram_set(t, n, words) for t in texts(b.column("text"))]
            ids = [set_ids(s) for s in sets]
            more = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array([sketch(s, percent) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *more], schema.names)

    return docs.mapInArrow(run, schema)


def block_keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """key, sid: the blocks of each set; a task gives each set once."""
    classes = Classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for b in batches:
            keys, ids, sizes = [], [], []
            for t in texts(b.column("text")):
                s = ngram_set(t, n, words)
                sid = set_ids(s)[0]
                if len(s) and sid not in seen:
                    seen.add(sid)
                    own = classes.keys(s)
                    keys += own
                    ids.append(sid)
                    sizes.append(sum(map(len, own)))
            if keys:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.repeat(np.array(ids, np.int64), sizes))], ["key", "sid"])

    return docs.select("text").mapInArrow(run, "key long, sid long")


def meetings(keys: DataFrame) -> DataFrame:
    """key, leader, sid: for each block that several sets share, its first set with each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (first,), (other,) in several(batches, "key", ["sid"]):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(first), pa.array(other)], ["key", "leader", "sid"])

    return keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(run, "key long, leader long, sid long")


def sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b, agree, bytes of the pairs that their sketches do not rule out; bytes: of b's set."""
    one = sketches.select(F.col("sid").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("x"))
    two = sketches.select(F.col("sid").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys, na, nb = b.column("x").to_pylist(), b.column("y").to_pylist(), column(b, "na"), column(b, "nb")
            size = np.array([min(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], np.int64)
            ok = np.zeros(len(size), bool)
            for k in np.unique(size).tolist():
                r = np.flatnonzero(size == k)
                ok[r] = may_reach(folded([xs[i] for i in r.tolist()], k), folded([ys[i] for i in r.tolist()], k), na[r], nb[r], percent)
            keep_ = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(keep_) for c in ("a", "b", "agree")], pa.array(8 * nb[ok])], ["a", "b", "agree", "bytes"])

    return pairs.join(two, "b").join(one, "a").select("a", "b", "agree", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, agree long, bytes long")


def add_overlaps(count: np.ndarray, hx: np.ndarray, rx: np.ndarray, hy: np.ndarray, ry: np.ndarray) -> None:
    """Adds the product of two sparse blocks, given as columns h and rows r of their ones, to count."""
    m, n = count.shape
    columns, ix = np.unique(hx, return_inverse=True)
    if not len(columns):
        return
    at = np.searchsorted(columns, hy).clip(max=len(columns) - 1)
    same = columns[at] == hy
    iy, ry = at[same], ry[same]
    nx, ny = np.bincount(ix, minlength=len(columns)), np.bincount(iy, minlength=len(columns))
    light = (nx * ny <= LIGHT) | (nx == 1) | (ny == 1)
    order = np.argsort(ix, kind="stable")
    rows, first = rx[order], np.cumsum(nx) - nx
    some = np.flatnonzero(light[iy])
    c, times = iy[some], nx[iy[some]]
    x = rows[np.repeat(first[c] - np.cumsum(times) + times, times) + np.arange(times.sum())]
    np.add.at(count.reshape(-1), x * n + np.repeat(ry[some], times), 1)
    heavy = np.flatnonzero(~light & (ny > 0))
    for i in range(0, len(heavy), CHUNK):
        part = heavy[i : i + CHUNK]
        place = np.full(len(columns), -1)
        place[part] = np.arange(len(part))
        a, b = np.zeros((m, len(part)), np.float32), np.zeros((n, len(part)), np.float32)
        for z, r, j in ((a, rx, place[ix]), (b, ry, place[iy])):
            z[r[j >= 0], j[j >= 0]] = 1
        count += a @ b.T


def tile_product(xs: list[np.ndarray], ys: list[np.ndarray], open_: np.ndarray, percent: int) -> np.ndarray:
    """Which of the open pairs (of a row of xs and one of ys) reach the threshold. Overlaps add up over blocks of
    columns; a pair closes when what is left cannot bring it to its bound, and a row without open pairs drops out."""
    cuts = np.arange(1, STEPS, dtype=np.uint64) << U(61)
    ends = [np.array([[0, *np.searchsorted(s, cuts).tolist(), len(s)] for s in side], np.int64).reshape(-1, STEPS + 1) for side in (xs, ys)]
    sizes = [e[:, -1] for e in ends]
    need = needed(sizes[0][:, None], sizes[1], percent)
    open_ = open_ & (np.minimum(sizes[0][:, None], sizes[1]) >= need)
    count = np.zeros(open_.shape, np.float32)
    for k in range(STEPS):
        parts = []
        for side, e, live in ((xs, ends[0], open_.any(1)), (ys, ends[1], open_.any(0))):
            rows = np.flatnonzero(live)
            some = [side[i][e[i, k] : e[i, k + 1]] for i in rows.tolist()]
            parts += [np.concatenate(some) if some else np.empty(0, np.uint64), np.repeat(rows, [len(s) for s in some])]
        if not len(parts[1]) and not open_.any():
            break
        add_overlaps(count, *parts)
        left = [n - e[:, k + 1] for n, e in zip(sizes, ends, strict=True)]
        open_ &= count + np.minimum(left[0][:, None], left[1]) >= need
    return open_


def product(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold. A tile is a row a with its partners b, of bounded bytes: more
    partners are dealt over several tiles."""
    heavy = pairs.groupBy("a").agg(F.ceil(F.sum("bytes") / TILE_BYTES).alias("parts")).where("parts > 1")
    p = pairs.join(heavy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    members = p.select("a", "part", F.lit(1).alias("side"), F.col("b").alias("sid")).unionByName(p.select("a", "part").distinct().select("a", "part", F.lit(0).alias("side"), F.col("a").alias("sid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles():
            tile, row, ids, held = None, None, [], []
            for b in batches:
                for key, side, sid, grams in zip(zip(*[b.column(c).to_pylist() for c in ("a", "part")], strict=True), *[b.column(c).to_pylist() for c in ("side", "sid", "grams")], strict=True):
                    if key != tile:
                        if ids:
                            yield tile[0], row, ids, held
                        tile, row, ids, held = key, None, [], []
                    if side == 0:
                        row = np.frombuffer(grams, np.uint64)
                    elif not ids or ids[-1] != sid:  # copies of a text give its set again
                        ids.append(sid)
                        held.append(np.frombuffer(grams, np.uint64))
            if ids:
                yield tile[0], row, ids, held

        for a, row, ids, held in tiles():
            good = np.array(ids, np.int64)[tile_product([row], held, np.ones((1, len(ids)), bool), percent)[0]]
            if len(good):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), a, np.int64)), pa.array(good)], ["a", "b"])

    rows = members.join(sets, "sid").repartition("a", "part").sortWithinPartitions("a", "part", "side", "sid")
    return rows.select("a", "part", "side", "sid", "grams").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """sid, root: the smallest sid reachable, for every sid that has a link. Stars are merged in rounds
    (large-star, small-star); each round is a table in the shared folder. The least neighbour is found by partial
    aggregation; the join that brings it back is one that Spark can split where a star is large."""
    edges, before = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), None

    def with_least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, edges = edges, keep(small, "stars")
        forget(old)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("sid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct())
        before = state


def bucket_tiles(met: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """key, i, j, part, sid, root, size, sketch: rows of buckets of three or more rows that lie in several components,
    in tiles (i, j) of bounded size. Parts are dealt by component: the largest one of a bucket has parts of its own,
    which meet those of all others but not each other, so linked rows do not travel in pairs."""
    wide = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")  # of two rows the pair is known
    rows = met.join(wide, "key", "left_semi")
    rows = rows.select("key", "sid").unionByName(rows.select("key", F.col("leader").alias("sid")).distinct())
    rows = rows.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rows = rows.join(sketches.select("sid", "size"), "sid")
    each = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    deal = each.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root", "bytes")).alias("big"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("roots > 1")
    others, theirs = F.col("n") - F.col("big.n"), F.col("bytes") - F.col("big.bytes")
    side = F.least(F.lit(4 * TILE), TILE * TILE / F.least(others, F.lit(TILE)))  # few others meet more rows at once
    parts = lambda n, most, size: F.greatest(F.ceil(n / most), F.ceil(size * 8 / TILE_BYTES)).cast("int")
    deal = deal.select("key", "roots", F.col("big.root").alias("big"), parts(F.col("big.n"), side, F.col("big.bytes")).alias("p"), parts(others, TILE, theirs).alias("q"))
    rows = rows.join(deal, "key").join(sketches.select("sid", "sketch"), "sid")
    rows = rows.withColumn("part", F.expr("cast(if(root = big, pmod(xxhash64(sid), p), p + pmod(xxhash64(sid), q)) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("if(root = big, sequence(p, p + q - 1), sequence(0, if(roots > 2, p + q, p) - 1))")))
    return rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid", "root", "size", "sketch")


def tile_candidates(tiles: DataFrame, percent: int, last: bool = False) -> DataFrame:
    """a, b, bytes: pairs of rows in different components that sketches do not rule out. Of a tile with more than
    DENSE such pairs for each row, each row's likeliest pair, and the rows that have one: key, i, j, part, sid, root
    (a is null). If this is the last round, only such rows, of every tile."""
    most = 0 if last else DENSE
    names = ["a", "b", "bytes", "key", "i", "j", "part", "sid", "root"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """t: whole tiles, in order."""
        key, i, j, part, sid, root, size = (t[c].to_numpy() for c in ("key", "i", "j", "part", "sid", "root", "size"))
        sketches = t["sketch"].to_pylist()
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        many = np.diff(np.r_[start, len(key)])
        tile = np.repeat(np.arange(len(start)), many)
        width = np.minimum.reduceat(np.array([len(x) for x in sketches]), start)
        pairs = [np.empty((3, 0), np.int64)]
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width[tile] == w)
            bits, of = folded([sketches[k] for k in rows.tolist()], w), tile[rows]
            got = [np.empty((3, 0), np.int64)]
            for d in range(1, int(many[width == w].max())):  # each row with the d-th after it in its tile
                x = np.flatnonzero(of[d:] == of[:-d])
                if not len(x):
                    break
                r, q = rows[x], rows[x + d]
                ok = (root[r] != root[q]) & ((part[r] != part[q]) | (i[r] == j[r]))
                x, r, q = x[ok], r[ok], q[ok]
                ok = may_reach(bits[x], bits[x + d], size[r], size[q], percent)
                differ = np.bitwise_count(bits[x[ok]] ^ bits[x[ok] + d]).sum(1, dtype=np.int64)
                got.append(np.stack([r[ok], q[ok], differ]))
            pairs.append(np.concatenate(got, 1))
        r, q, differ = np.concatenate(pairs, 1)
        dense = np.bincount(tile[r], minlength=len(start)) > most * many
        some = dense[tile[r]]
        whole = np.unique(np.r_[r[some], q[some]])
        if last:
            r = q = r[:0]
        else:
            each, other, bits_ = np.r_[r[some], q[some]], np.r_[q[some], r[some]], np.r_[differ[some], differ[some]]
            order = np.lexsort((bits_, each))
            order = order[np.r_[True, np.diff(each[order]) > 0]] if len(order) else order
            r, q = np.r_[r[~some], each[order]], np.r_[q[~some], other[order]]
        a, b = np.minimum(sid[r], sid[q]), np.maximum(sid[r], sid[q])
        once = np.lexsort((b, a))  # a pair that shares several blocks lies in as many tiles
        once = once[np.r_[True, (a[once[1:]] != a[once[:-1]]) | (b[once[1:]] != b[once[:-1]])]] if len(r) else once
        a, b, r, q = a[once], b[once], r[once], q[once]
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(8 * np.maximum(size[r], size[q])), *[pa.nulls(len(r), k) for k in kinds[3:]]], names)
        if len(whole):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(whole), k) for k in kinds[:3]], *[pa.array(v[whole], k) for v, k in zip((key, i, j, part, sid, root), kinds[3:], strict=True)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            key, i, j = (t[c].to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(new) and len(t) >= TILE:
                cut = int(new[-1]) + 1
                yield from found(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))
        give_back()

    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sid").mapInArrow(run, "a long, b long, bytes long, key long, i int, j int, part int, sid long, root long")


def dense_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links of whole tiles (key, i, j, part, sid, root), as many as join components within the tile."""

    def multiply(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("sid", "ascending")])
        sid = t["sid"].to_numpy()
        first = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])  # copies of a text give its set again
        t, sid = t.take(first), sid[first]
        part, root = t["part"].to_numpy(), t["root"].to_numpy()
        rows, one = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()], t["i"][0].as_py() == t["j"][0].as_py()
        x = np.arange(len(sid)) if one else np.flatnonzero(part == part[0])
        y = np.arange(len(sid)) if one else np.flatnonzero(part != part[0])
        open_ = root[x][:, None] != root[y]
        if one:
            open_ &= x[:, None] < y
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while parent.get(k, k) != k:
                k = parent[k]
            return k

        out = []
        for k, m in np.argwhere(tile_product([rows[k] for k in x.tolist()], [rows[k] for k in y.tolist()], open_, percent)).tolist():
            p, q = find(int(root[x[k]])), find(int(root[y[m]]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((sid[x[k]], sid[y[m]]))
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(at[:, 0]), pa.array(at[:, 1])], ["a", "b"])

    return tiles.join(sets, "sid").select("key", "i", "j", "part", "sid", "root", "grams").groupBy("key", "i", "j").applyInArrow(multiply, "a long, b long")


def linked(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame | None:
    """sid, root of the sets of `rows` (summaries of docs) that have links, or None."""
    met = keep(meetings(block_keys(docs, n, percent)), "blocks")
    pairs = met.groupBy(F.col("leader").alias("a"), F.col("sid").alias("b")).agg(F.count(F.lit(1)).alias("agree"))
    ids = met.select("sid").union(met.select("leader")).distinct()
    of_sets = rows.groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"))
    sketches = keep(of_sets.join(ids, "sid", "left_semi"), "sketches")
    near = keep(sketched(pairs, sketches, percent), "near")
    made = []

    def sets_of(sids: DataFrame) -> DataFrame:
        """sid, grams, made again from the text of one document for each set."""
        made.append(keep(sketches.join(sids.distinct(), "sid", "left_semi").select("id").distinct(), "chosen"))
        chosen = F.broadcast(made[-1]) if made[-1].count() <= BROADCAST_IDS else made[-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, seen = WordHashes(), set()
            for b in batches:
                out = {}
                for t in texts(b.column("text")):
                    s = ngram_set(t, n, words)
                    if (sid := set_ids(s)[0]) not in seen:
                        seen.add(sid)
                        out[sid] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["sid", "grams"])

        texts_of = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).join(chosen, "id", "left_semi").select("text")
        return texts_of.mapInArrow(run, "sid long, grams binary")

    def both(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("sid")).union(p.select("b"))

    best = near.groupBy("b").agg(F.max(F.struct("agree", "a", "bytes")).alias("best")).select("best.a", "b", "best.bytes")
    links = keep(product(best, sets_of(both(best)), percent), "links")
    roots = keep(components(links), "roots")
    forget(links)
    root = lambda c, out: roots.select(F.col("sid").alias(c), F.col("root").alias(out))
    apart = lambda p: p.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "bytes")
    tiles = keep(tile_candidates(bucket_tiles(met, roots, sketches), percent), "candidates")
    others = near.join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "bytes")
    rest = keep(apart(others).unionByName(tiles.where("a is not null").select("a", "b", "bytes")).groupBy("a", "b").agg(F.max("bytes").alias("bytes")), "rest")

    def merged(found: DataFrame) -> DataFrame:
        """roots, with the links of one more round."""
        links = keep(found, "links")
        out = roots
        if not links.isEmpty():
            known = roots.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
            out = keep(components(known.unionByName(links)), "roots")
            forget(roots)
        forget(links)
        return out

    if not rest.isEmpty():
        roots = merged(product(rest, sets_of(both(rest)), percent))
    whole = tiles.where("a is null").drop("a", "b", "bytes", "root")
    if not whole.isEmpty():
        d = whole.join(root("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        open_ = d.groupBy("key", "i", "j").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "i", "j")
        d = d.join(open_, ["key", "i", "j"]).join(sketches.select("sid", "size", "sketch"), "sid").select("key", "i", "j", "part", "sid", "root", "size", "sketch")
        d = keep(tile_candidates(d, percent, last=True).drop("a", "b", "bytes"), "tiles")
        if not d.isEmpty():
            roots = merged(dense_links(d, sets_of(d.select("sid")), percent))
        forget(d)
    forget(met, sketches, near, tiles, rest, *made)
    return roots


def joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """`docs` (doc_id, text and more) without text, with n_shingles and root: equal for the rows of a component, null
    without n-grams."""
    small_batches(docs.sparkSession)
    rows = keep(summaries(docs, n, percent), "sets")
    roots = linked(docs.select("doc_id", "text"), rows, n, percent)
    kept = [c for c in docs.columns if c != "text"]
    d = rows.join(roots, "sid", "left")
    own = F.struct(F.coalesce("root", "sid").alias("sid"), F.when(F.col("root").isNull(), F.col("sid2")).alias("sid2"))  # sets without links go by all 128 bits
    return d.select(*kept, "n_shingles", F.when(F.col("n_shingles") > 0, own).alias("root"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (columns doc_id, text)."""
    d = joined(docs.select("doc_id", "text"), n, percent)
    some = d.where("root is not null")
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    none = d.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(least, "root").select("doc_id", "n_shingles", "component_id").unionByName(none)


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with one row of each component: that with the smallest id (none comes last), of several the one with the
    least hash of all columns. Rows without n-grams stay."""
    id_, row = F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), row_hash(docs).alias("row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = joined(docs.select("doc_id", "text", row), n, percent).where("root is not null")
    found = keep(found.select("root", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row", place.alias("place")), "components")
    first = found.groupBy("root").agg(F.min("place").alias("first"))
    gone = keep(found.join(first, "root").where("place <> first").select("id", "row").distinct(), "gone")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_, row)
    left = own.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["id", "row"], "left_anti")
    twice = keep(found.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "row"), "twice")
    if not twice.isEmpty():  # rows alike in all columns
        few = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
        left = left.join(few, ["id", "row"], "left_anti").unionByName(left.join(few, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]))
    return left.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
