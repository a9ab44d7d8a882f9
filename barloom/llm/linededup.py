r"""Line dedup over the corpus, exact and within one edit, by a deletion-neighbourhood join.

Lines are what \n separates. A line goes when an equal line stands earlier (smaller doc_id, then
line number), or an earlier line differs by one inserted, deleted or replaced character, whatever its
length. Lines of white space only always stay. Documents stay, too,
even when no line is left (their text is then empty).

The neighbourhood of a line is all its variants with one character deleted, as hashed keys with
the place of the deletion; a key's lines are within one edit of each other, so the earliest of a key
decides, after a check of the edit distance. Keys are made per piece of 64 characters (the hashes of
what stands before and after it belong to the key), so long lines cost no more per character, and
only for lines that share a half with another line: two lines within one edit always do.

Nulls: a null text stays null; a null id sorts last. Rows that share an id are told apart by a hash
of the row; rows equal in all columns are one document and come out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, row_hash

PIECE = 64
#: Up to so many hashed keys are broadcast (16 MB); more go through a shuffle join.
BROADCAST_KEYS = 2_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """line, h1, h2, pos (doc_id or the largest, row, no). One row per line that is not blank."""
    d = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), row_hash(docs).alias("row"), F.split("text", "\n").alias("lines"))
    d = d.select("id", "row", F.posexplode("lines").alias("no", "line")).where(F.col("line").rlike(r"\S"))
    return d.select("line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), F.struct("id", "row", "no").alias("pos"))


def halves(n: str = "n") -> str:
    """Keys of which two lines within one edit share at least one: a half from the left or from the right."""
    one = "xxhash64({m}, 0, left(line, cast(({m} - 1) div 2 as int))), xxhash64({m}, 1, right(line, cast({m} - 1 - ({m} - 1) div 2 as int)))"
    return f"array({one.format(m=n)}, {one.format(m=f'({n} + 1)')})"


def variants(lines: DataFrame) -> DataFrame:
    """pos, key: one key per deleted character (as the longer line or one of equal length) and one per
    place where a longer line may have one more."""
    d = lines.select("pos", "line", F.length("line").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    d = d.withColumn("m", F.col("n") + F.col("more")).withColumn("e", F.explode(F.expr(f"sequence(0, cast((m - 1) div {PIECE} as int))")))
    d = d.selectExpr(
        "pos", "more", "m", "e", f"greatest(0, m - {PIECE} * (e + 1)) as after", "n", "line",
    ).selectExpr(
        "pos", "more", f"xxhash64(m, e, left(line, {PIECE} * e), right(line, after)) as around", f"substring(line, {PIECE} * e + 1, n - {PIECE} * e - after) as mid", f"least({PIECE}, m - {PIECE} * e) as places",
    )
    d = d.withColumn("i", F.explode(F.expr("sequence(0, cast(places as int) - 1)")))
    return d.selectExpr("pos", "xxhash64(around, i, left(mid, i), substring(mid, i + 2 - more)) as key")


def near_lines(lines: DataFrame) -> DataFrame:
    """pos of each distinct line that has an earlier line within one edit."""
    sized = lines.withColumn("n", F.length("line"))
    keyed = sized.select("h1", F.explode(F.expr(halves())).alias("key"))
    shared = keep(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"), "line-halves")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    some = sized.withColumn("key", F.explode(F.expr(halves()))).join(shared, "key", "left_semi")
    some = keep(some.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.any_value("line").alias("line")), "near-lines")
    group = Window.partitionBy("key")
    pairs = variants(some).withColumn("first", F.min("pos").over(group)).where("pos > first").select("pos", "first").distinct()
    a, b = some.select("pos", "line"), some.select(F.col("pos").alias("first"), F.col("line").alias("earlier"))
    return pairs.join(a, "pos").join(b, "first").where("levenshtein(line, earlier, 1) between 0 and 1").select("pos").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with its later lines removed; n_chars, where there is one, follows the new text.

    What is kept travels as line numbers, one row per distinct line; texts move once."""
    lines = lines_of(docs)
    first = lines.groupBy("h1", "h2").agg(F.min("pos").alias("pos")).select("pos")
    first = first.join(near_lines(lines), "pos", "left_anti")
    kept = first.select("pos.*").groupBy("id", "row").agg(F.collect_list("no").alias("nos"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), row_hash(docs).alias("row"))
    d = d.dropDuplicates(["id", "row"]).join(kept, ["id", "row"], "left")
    text = F.expr(r"array_join(filter(split(doc.text, '\n'), (x, i) -> not x rlike '\\S' or array_contains(coalesce(nos, array()), i)), '\n')")
    d = d.withColumn("kept_text", text)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return d.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])
