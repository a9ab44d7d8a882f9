"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are cut into pieces of at most `capacity` words. Pieces are dealt over shards by a hash;
a shard's pieces go, largest first, into the bin with the least room that holds the piece and does
not conflict: bins carry bitmaps of their duplicate clusters (no cluster twice) and of their sources
(none above its limit: twice the pieces it would have in a full bin of average content, `per_source` at
least, so no source crowds a bin and few sources still fill one). Bins stand in order of their room; the search goes from the
tightest to its successors until one is compatible, and opens a bin if none is.

Nulls: a null text or one without words has no pieces: one row, with null bin. A null source or
cluster is a value like another. Repeated rows are pieces of their own, and of one cluster.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD


def source_limits(sizes: list[int], sources: list[int], capacity: int, per_source: int) -> list[int]:
    """How often each source may stand in a bin."""
    total = sum(sizes)
    return [max(per_source, -(-2 * n * capacity // total)) for n in np.bincount(sources).tolist()] if sizes else []


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, limits: list[int]) -> tuple[list[int], list[int]]:
    """Bin and place in it of each piece; sizes fall. sources and clusters: small numbers, bits of the bitmaps;
    limits: how often each source may stand in a bin."""
    order: list[tuple[int, int]] = []  # (room, bin)
    seen: list[int] = []  # clusters of a bin
    full: list[list[int]] = []  # sources that a bin has at least once, twice, ...
    bins, places = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c, most = 1 << source, 1 << cluster, limits[source]
        i = bisect_left(order, (size, -1))
        while i < len(order) and (seen[order[i][1]] & c or len(full[order[i][1]]) >= most and full[order[i][1]][most - 1] & s):
            i += 1
        if i < len(order):
            room, k = order.pop(i)
        else:
            room, k = capacity, len(seen)
            seen.append(0)
            full.append([])
        seen[k] |= c
        level = full[k]
        j = 0
        while j < len(level) and level[j] & s:
            j += 1
        if j == len(level):
            level.append(0)
        level[j] |= s
        bins.append(k)
        places.append(capacity - room)
        if room > size:
            insort(order, (room - size, k))
    return bins, places


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, cluster=None, docs_per_shard: int = 1000) -> DataFrame:
    """doc_id, source, piece, first_word, n_words, shard, bin, place. Bins are numbered within a shard.

    cluster: a column that equal or near documents share; by default a hash of the text, lower-cased,
    with white space folded."""
    shards = max(1, math.ceil(docs.count() / docs_per_shard))
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.xxhash64(folded) if cluster is None else cluster).alias("cluster"), words.alias("words"))
    d = d.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (words - 1) div {capacity}))"))).withColumn("first_word", F.col("piece") * capacity)
    d = d.withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("first_word")).cast("long"))
    d = d.select("doc_id", "source", "cluster", "piece", "first_word", "n_words")
    some = d.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)).cast("int"))
    schema = "doc_id long, source string, piece long, first_word long, n_words long, shard int, bin int, place long"

    def pack_shard(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        number = lambda c: np.asarray(t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices).tolist()
        sizes, sources = t["n_words"].to_pylist(), number("source")
        bins, places = best_fit(sizes, sources, number("cluster"), capacity, source_limits(sizes, sources, capacity, per_source))
        out = t.select(["doc_id", "source", "piece", "first_word", "n_words", "shard"])
        return out.append_column("bin", pa.array(bins, pa.int32())).append_column("place", pa.array(places, pa.int64()))

    packed = some.groupBy("shard").applyInArrow(pack_shard, schema)
    none = d.where("n_words <= 0").select("doc_id", "source", "piece", "first_word", "n_words", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("place"))
    return packed.unionByName(none)
