r"""Benchmark decontamination by winnowing, with DataFrame and SQL functions only.

Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased. A window is `size` consecutive
words of an item (all words of an item that has fewer). The fingerprint of a window is the minimum hash of its
k-grams, and a span of a document has the same one where it holds the same words, so every shared span is found: the
guarantee of winnowing with k + w - 1 = size. Runs of equal minima are one fingerprint with its place and length.
Fingerprints of documents and items are joined; each hit is extended over the windows of its run, which are then
joined with the items' windows by all their words.

Windows that have the same items are one class. Documents with the same set of classes share one list of items, which
is hashed once, so no pairs of documents and items arise. Items' tables are broadcast up to BROADCAST_ROWS rows, and
joined by shuffle beyond.

Nulls: a null text has no words; a null item_id counts as an item named by the empty string; items that share an id
are one item with the windows of all their texts; a null doc_id is a document. Rows with equal doc_id and text have
equal results; each row is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep

SIZE, GRAM = 10, 5
#: Up to so many rows of fingerprints, windows (of some 100 bytes) or documents' keys are broadcast.
BROADCAST_ROWS = 200_000
#: Letters that lower-casing would change, beyond A-Z: such texts take the slower way that leaves them alone.
_CASED = r"[[^\x00-\x7F]&&[^\p{Ll}\p{Lo}\p{P}\p{Z}\p{M}]]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str):
    """Words of a text column, in order; none for null."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(t.rlike(_CASED), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def with_fingerprints(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """Adds `out`, an array of (n, at, len, fp): runs of windows of n words whose minimum k-gram hash is the same. The
    first window of a run stands at word `at`, counted from 0; fewer words have none."""
    k = min(GRAM, n)
    gram = ", ".join(f"get({words}, i + {j})" for j in range(k))
    df = df.withColumn("grams_", F.expr(f"if(size({words}) < {n}, array(), transform(sequence(0, greatest(0, size({words}) - {k})), i -> xxhash64({gram})))"))
    if n > k:
        least = ", ".join(f"get(grams_, i + {j})" for j in range(n - k + 1))
        df = df.withColumn("minima_", F.expr(f"if(size(grams_) = 0, array(), transform(sequence(0, greatest(0, size(grams_) - {n - k + 1})), i -> least({least})))"))
    else:
        df = df.withColumnRenamed("grams_", "minima_")
    df = df.withColumn("heads_", F.expr("filter(transform(minima_, (x, i) -> if(i > 0 and x = get(minima_, i - 1), -1, i)), i -> i >= 0)"))
    runs = f"transform(heads_, (i, j) -> struct({n} as n, i as at, coalesce(get(heads_, j + 1), size(minima_)) - i as len, xxhash64({n}, get(minima_, i)) as fp))"
    return df.withColumn(out, F.expr(runs)).drop("grams_", "minima_", "heads_")


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item, n, words): the windows of each item, as arrays of words."""
    d = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("all")).where("size(all) > 0")
    d = d.withColumn("n", F.least(F.size("all"), F.lit(size))).withColumn("i", F.explode(F.expr("sequence(1, size(all) - n + 1)")))
    return d.select("item", "n", F.expr("slice(all, i, n)").alias("words")).distinct()


def _sized(table: DataFrame) -> DataFrame:
    """A kept table, broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _keys(text: str) -> list:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")]


def candidates(docs: DataFrame, fingerprints: DataFrame, lengths: list[int]) -> DataFrame:
    """One row for each document (at -1, len its words), and one for each run whose fingerprint is one of the items'."""
    d = docs.select("doc_id", *_keys("text"), words_of("text").alias("words"))
    for n in lengths:
        d = with_fingerprints(d, "words", n, f"runs_{n}")
    own = "array(struct(0 as n, -1 as at, size(words) as len, t1 as fp))"
    d = d.select("doc_id", "t1", "t2", F.expr(f"inline(concat({', '.join([own, *[f'runs_{n}' for n in lengths]])}))"))
    known = _sized(fingerprints).withColumn("known", F.lit(True))
    return d.join(known, "fp", "left").where("at < 0 or known").select("doc_id", "t1", "t2", "n", "at", "len")


def occurrences(docs: DataFrame, spots: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (t1, t2, n, start, c1, c2): where the items' windows stand in the texts. spots: t1, t2, and the runs
    that share a fingerprint."""
    d = docs.select(*_keys("text"), "text").join(_sized(spots), ["t1", "t2"]).select("t1", "t2", words_of("text").alias("words"), "runs")
    d = d.withColumn("starts", F.expr("array_distinct(flatten(transform(runs, r -> transform(sequence(r.at, r.at + r.len - 1), i -> struct(r.n as n, i as start)))))"))
    d = d.select("t1", "t2", F.explode(F.expr("transform(starts, s -> struct(s.n as n, s.start as start, array_join(slice(words, s.start + 1, s.n), ' ') as span))")).alias("s")).select("t1", "t2", "s.*")
    return d.join(_sized(windows), "span").select("t1", "t2", "n", "start", "c1", "c2").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the sorted ids of the
    items whose windows occur, joined by commas), contaminated. docs: doc_id, text. items: item_id, text."""
    every = keep(windows_of(items, size), "item-windows")
    lengths = sorted(r.n for r in every.select("n").distinct().collect())  # at most `size` numbers
    one = every
    for n in lengths:
        one = with_fingerprints(one, "words", n, f"runs_{n}")
    fp = F.coalesce(*[F.when(F.col("n") == n, F.expr(f"get(runs_{n}, 0).fp")) for n in lengths]) if lengths else F.lit(0).cast("long")
    prints = keep(one.select(fp.alias("fp")).distinct(), "item-fingerprints")
    spans = every.select("item", F.array_join("words", " ").alias("span"))
    classes = keep(spans.groupBy("span").agg(F.bit_xor(F.xxhash64("item")).alias("c1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("c2")), "windows")
    of_class = keep(spans.join(_sized(classes), "span").select("c1", "c2", "item").distinct(), "classes")

    found = keep(candidates(docs, prints, lengths), "candidates")
    spots = keep(found.where("at >= 0").groupBy("t1", "t2").agg(F.collect_set(F.struct("n", "at", "len")).alias("runs")), "spots")
    hits = occurrences(docs, spots, classes)
    covered = "aggregate(spots, struct(0L as hit, 0 as reach), (a, x) -> struct(a.hit + greatest(0, x.start + x.n - greatest(x.start, a.reach)) as hit, greatest(a.reach, x.start + x.n) as reach), a -> a.hit)"
    per_text = hits.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spots"), F.array_sort(F.collect_set(F.struct("c1", "c2"))).alias("classes"))
    per_text = keep(per_text.select("t1", "t2", F.expr(covered).alias("n_hit"), "classes", F.xxhash64("classes").alias("s1"), F.xxhash64(F.lit(1), "classes").alias("s2")), "hits")
    lists = per_text.select("s1", "s2", F.explode("classes").alias("c")).distinct().select("s1", "s2", "c.c1", "c.c2")
    lists = lists.join(_sized(of_class), ["c1", "c2"]).select("s1", "s2", "item").distinct().groupBy("s1", "s2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    lists = lists.select("s1", "s2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    results = keep(per_text.join(lists, ["s1", "s2"]).select("t1", "t2", "n_hit", "n_items", "items_sha256"), "results")
    forget(every, prints, classes, of_class, spots, per_text)
    d = found.where("at < 0").select("doc_id", "t1", "t2", F.col("len").cast("long").alias("n_words")).join(_sized(results), ["t1", "t2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
