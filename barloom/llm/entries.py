"""Queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ship

from . import chat, digest, lexical, linededup, mixing, mpeg, ngramjoin, packing, prefixtrie, quality, suffixes, toxicity, winnow
from .common import documents, held_out, small_batches
from .oracles import ORACLES


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mpeg.digest(mpeg.probe_audio(mpeg.store_audio(mpeg.payloads(documents(spark, sf_dir))).drop("payload")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d = toxicity.score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels).withColumnRenamed("toxicity", "score")
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_sources(documents(spark, sf_dir))
    return d.select("doc.doc_id", "size", "source_size", "target", "taken", "shard", F.size("spans").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d = quality.score_quality(documents(spark, sf_dir).select("doc_id", "text"), labels).withColumnRenamed("quality", "score")
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint_report(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return linededup.dedup_lines(docs).select("doc_id", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.size(F.split("text", "\n")).alias("kept_lines"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_examples(chat.expand_prefixes(turns.unionByName(more)))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mpeg_audio, op2_toxicity, op3_ngram_join, op4_source_mix, op5_quality, op6_exact_digest, op7_line_dedup, op8_best_fit_packing, op9_suffix_dedup, op10_chat_prefixes, op11_lexical_search, op12_winnowing, op13_prefix_trie)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
