"""Mixing sources to target weights by Sainte-Laguë apportionment.

The documents of a shard and source, in a seeded order, form one stream of words that is cut into
blocks of equal size. Each shard gives its blocks to sources by highest quotients target/(2k+1);
the quota is an integer. A source with more quota than blocks repeats all of them whole times; the
rest of the quota goes to the blocks with the least seeded hashes. Document-level results follow from
where a document lies in its stream.

Shards, orders and choices go by md5 of a seeded name, which other engines have, too. A document's name is
its id, and without one its text's md5.

Nulls: a null text has size 0; a null source is a source of its own, after the others. Repeated rows are
documents of their own. Columns of any name are kept, in the struct `doc`. No rows in, no rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


def _seeded(what: str, seed: int, *parts) -> Column:
    """60 bits of the md5 of `what`, the seed and the parts."""
    name = F.concat_ws(" ", F.lit(what), F.lit(str(seed)), *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """source, source_size, rank, target. `sizes`: one row per source with its size (a few rows: sources).

    Shares of all words by weight; a target stops at `limit` times its source's size and the excess
    goes to the others by weight. The sources that stop are those with the least size per weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    s = s.withColumn("room", F.col("source_size") * limit)
    w = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    before, everything = w.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / free).withColumn("full", F.col("room") <= F.col("level") * F.col("weight"))
    s = s.withColumn("place", F.row_number().over(w))
    s = s.withColumn("stop", F.min(F.when(~F.col("full"), F.col("place"))).over(everything))
    s = s.withColumn("level", F.max(F.when(F.col("place") == F.col("stop"), F.col("level"))).over(everything))
    target = F.when(F.col("place") < F.coalesce("stop", F.lit(1 << 30)), F.col("room").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return s.select("source", "source_size", "rank", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, block: int = 16, docs_per_shard: int = 1000, seed: int = 0) -> DataFrame:
    """doc (all columns of `docs`), size, source_size, target, taken, shard, repeats (whole times), spans.

    spans: the word ranges [from, to) of the document that are taken once more than `repeats`."""
    shards = max(1, math.ceil(docs.count() / docs_per_shard))
    # Columns travel under names of their own, so that what nobody reads is not moved.
    own = {c: f"doc_{i}_" for i, c in enumerate(docs.columns)}
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    d = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in own.items()], "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (_seeded("shard", seed, name) % shards).alias("shard"), _seeded("order", seed, name).alias("place"),
    )
    mine = d.groupBy("shard", "source").agg(F.sum("size").alias("words"))
    per_source = source_targets(mine.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    q = mine.alias("m").join(per_source.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source"))).select("m.shard", "m.source", "words", "source_size", "rank", "target")
    q = q.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(F.lit(0.0)))
    q = q.withColumn("blocks", F.ceil(F.col("words") / F.lit(float(block))))
    of_shard = Window.partitionBy("shard")
    sum_in_order = F.sum("share").over(of_shard.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    q = q.withColumn("total", sum_in_order).withColumn("seats", F.round(F.col("total") / block).cast("long")).withColumn("n", F.count(F.lit(1)).over(of_shard))
    # The seats before and after which a source's number cannot fall: only quotients between them compete.
    part = F.when(F.col("total") > 0, F.col("share") / F.col("total")).otherwise(F.lit(0.0))
    most = F.col("blocks") * limit
    q = q.withColumn("low", F.least(most, F.greatest(F.lit(0), F.floor(part * (F.col("seats") - F.col("n") / 2.0)) - 1)).cast("long"))
    q = q.withColumn("high", F.least(most, F.ceil(part * (F.col("seats") + F.col("n") / 2.0)) + 1).cast("long"))
    q = q.withColumn("open", F.col("seats") - F.sum("low").over(of_shard))
    bids = q.withColumn("k", F.explode(F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1)).otherwise(F.array(F.lit(-1).cast("long")))))
    quotient = F.when(F.col("k") >= 0, F.col("share") / (2 * F.col("k") + 1)).otherwise(F.lit(-1.0))
    won = F.row_number().over(of_shard.orderBy(quotient.desc(), "rank", "k")) <= F.col("open")
    quotas = bids.withColumn("won", (won & (F.col("k") >= 0)).cast("long")).groupBy("shard", "source", "rank", "source_size", "target", "blocks", "low").agg(F.sum("won").alias("won"))
    quotas = quotas.select("shard", "source", "source_size", "target", "rank", "blocks", (F.col("low") + F.col("won")).alias("quota"))
    blocks = F.greatest("blocks", F.lit(1))
    quotas = quotas.select("shard", "source", "source_size", "target", "rank", F.floor(F.col("quota") / blocks).alias("repeats"), F.pmod(F.col("quota"), blocks).alias("extra"), "blocks")
    # The rest of a quota: so many blocks have a hash up to this one.
    hashed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: _seeded("block", seed, "shard", "rank", b))
    quotas = quotas.withColumn("upto", F.when(F.col("extra") > 0, F.element_at(F.array_sort(hashed), F.col("extra").cast("int")))).drop("blocks")
    # Where each document lies in its stream; rows alike in all of the order may change places.
    stream = Window.partitionBy("shard", "source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    d = d.alias("d").join(quotas.alias("q"), (F.col("d.shard") == F.col("q.shard")) & F.col("d.source").eqNullSafe(F.col("q.source")))
    d = d.select(*own.values(), "size", "source_size", "target", "d.shard", "start", "end", "rank", "repeats", "extra", "upto")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    chosen = F.filter(F.sequence(first, last), lambda b: _seeded("block", seed, "shard", "rank", b) <= F.col("upto"))
    span = lambda b: F.struct((F.greatest("start", b * block) - F.col("start")).alias("from"), (F.least("end", (b + 1) * block) - F.col("start")).alias("to"))
    d = d.withColumn("spans", F.when((F.col("size") > 0) & (F.col("extra") > 0), F.transform(chosen, span)).otherwise(F.array()))
    d = d.withColumn("taken", F.expr("size * repeats + aggregate(spans, 0L, (a, s) -> a + s.to - s.from)"))
    doc = F.struct(*[F.col(n).alias(c) for c, n in own.items()]).alias("doc")
    return d.select(doc, "size", "source_size", "target", "taken", "shard", "repeats", "spans")


def take_mixed(mixed: DataFrame) -> DataFrame:
    """The documents that a mix takes, in their own columns: a row for each whole repeat, and a row with the words of
    the spans. A document without words stays once."""
    columns = mixed.schema["doc"].dataType.names
    whole = F.greatest(F.col("repeats"), (F.col("size") == 0).cast("long"))
    copies = F.concat(F.when(whole > 0, F.sequence(F.lit(1).cast("long"), whole)).otherwise(F.array().cast("array<long>")), F.when(F.size("spans") > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")))
    d = mixed.select("doc", "spans", F.explode(copies).alias("copy"))
    words = F.array(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)))  # found once for all spans
    taken = lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
    d = d.withColumn("part", F.when(F.col("copy") == 0, F.element_at(F.transform(words, taken), 1)))
    new = {"text": F.col("part"), "n_chars": F.length("part")}
    kinds = {f.name: f.dataType for f in mixed.schema["doc"].dataType.fields}
    return d.select(*[F.when(F.col("copy") == 0, new[c].cast(kinds[c])).otherwise(F.col("doc")[c]).alias(c) if c in new else F.col("doc")[c].alias(c) for c in columns])
