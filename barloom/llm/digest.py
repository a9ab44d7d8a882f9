"""Canonical exact digest: Unicode normalisation, case and whitespace folding, then wide xxhash.

The canonical form is NFKC, case-folded, NFKC again, with runs of white space as one space and none
at the ends. The fingerprint is two 64-bit hashes of it. Rows whose fingerprints are equal are then
compared byte for byte; canonical texts that differ although their hashes agree get a suffix.

Nulls: a null text counts as empty. Equal texts (copies, repeated rows) have equal fingerprints.
All work is done by SQL functions in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows of two hashes are broadcast (32 MB); more go through a shuffle join.
BROADCAST_ROWS = 2_000_000


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the canonical form of column `text`."""
    nfkc = "reflect('com.ibm.icu.text.Normalizer', 'compose', {}, true)"
    folded = "reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {}, true)"
    return df.withColumn(out, F.expr(nfkc.format(folded.format(nfkc.format(f"coalesce({text}, '')"))))).withColumn(
        out, F.trim(F.regexp_replace(out, r"[\s\p{Z}\x{85}]+", " "))
    )


def wide_hash(canonical: str):
    """Two 64-bit hashes; the second starts from another state."""
    return F.xxhash64(canonical).alias("h1"), F.xxhash64(F.lit("second"), F.col(canonical)).alias("h2")


def _hex(h1, h2):
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def bucket_conflicts(df: DataFrame, canonical: str) -> DataFrame | None:
    """h1, h2, canonical, suffix (or None): texts that differ inside a bucket of equal hashes. Empty, but for chance.

    Only rows in buckets of two or more rows move their texts; copies meet in partial aggregation."""
    h = df.select(*wide_hash(canonical), F.col(canonical).alias("canonical"))
    several = h.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2").persist()
    n = several.count()
    texts = h.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, ["h1", "h2"], "left_semi").distinct()
    bucket = Window.partitionBy("h1", "h2")
    out = texts.withColumn("suffix", F.row_number().over(bucket.orderBy("canonical")) - 1).where("suffix > 0").persist()
    found = out.count()
    several.unpersist()
    return out if found else None


def with_fingerprint(df: DataFrame, canonical: str, out: str, conflicts: DataFrame | None = None) -> DataFrame:
    h1, h2 = wide_hash(canonical)
    if conflicts is None:
        return df.withColumn(out, _hex(h1, h2))
    c = conflicts.toDF("h1_", "h2_", "canonical_", "suffix_")
    d = df.join(c, (h1 == F.col("h1_")) & (h2 == F.col("h2_")) & (F.col(canonical) == F.col("canonical_")), "left")
    return d.withColumn(out, F.concat(_hex(h1, h2), F.coalesce(F.concat(F.lit("."), F.col("suffix_").cast("string")), F.lit("")))).select(*df.columns, out)


def exact_digest(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of column `text`."""
    d = with_canonical(df, text, "canonical_form")
    return with_fingerprint(d, "canonical_form", out, bucket_conflicts(with_canonical(df.select(text), text, "canonical_form"), "canonical_form")).drop("canonical_form")


def with_next(d: DataFrame, columns: list[str], order: str = "doc_id", tie: str = "tie", per_bucket: int = 500, most: int = 10_000) -> DataFrame:
    """Adds next_<column>: the value in the next row by `order` (nulls first), after the last the first.

    Rows fall into ranges of about `per_bucket` rows by quantiles; each range also gets a copy of the
    first row of the range after it, so no window spans all rows."""
    n = d.count()
    k = min(most, math.ceil(n / per_bucket))
    cuts = d.select(F.percentile_approx(order, [i / k for i in range(1, k)], 100_000)).first()[0] if k > 1 else None
    cuts = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(cuts)))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if cuts:
        coarse = F.array(*[F.lit(x[0]) for x in fine])
        at = F.size(F.filter(coarse, lambda b: b <= F.col(order)))
        inside = F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in fine]), F.greatest(at, F.lit(1))), lambda b: b <= F.col(order)))
        bucket = F.coalesce(F.when(at > 0, (at - 1) * step + inside).otherwise(0), F.lit(0))
    else:
        bucket = F.lit(0)
    d = d.withColumn("bucket", bucket)
    firsts = d.groupBy("bucket").agg(F.min(F.struct(F.col(order).isNotNull().alias("some"), F.col(order).alias("id"), F.col(tie).alias("tie"))).alias("first"))
    line = Window.orderBy("bucket")  # over at most `most` ranges
    last = F.max("bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(F.col("bucket").alias("b"), F.coalesce(F.lag("bucket").over(line), last).alias("before"), F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    d = d.join(F.broadcast(firsts), (F.col("bucket") == F.col("b")) & F.col(order).eqNullSafe(F.col("first_id")) & (F.col(tie) == F.col("first_tie")), "left")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy")))
    d = d.withColumn("place", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())))
    w = Window.partitionBy("place.bucket").orderBy("place.copy", F.col(order).asc_nulls_first(), tie)
    d = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return d.where(~F.col("place.copy")).drop("place", "bucket", "b", "before", "first_id", "first_tie")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Contract columns of op6."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    conflicts = bucket_conflicts(with_canonical(base, "text", "canonical"), "canonical")
    d = with_fingerprint(with_canonical(base, "text", "canonical"), "canonical", "fingerprint", conflicts).drop("canonical")
    d = with_next(d.withColumn("tie", F.xxhash64("text")), ["text", "fingerprint"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint")
    d = with_fingerprint(with_canonical(d, "edited", "canonical"), "canonical", "edited_fingerprint", conflicts)
    same = lambda x: (F.col("fingerprint") == F.col(x)).cast("double")
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
