"""Corpus pipeline: documents -> toxicity -> line dedup -> near duplicates -> source mix -> packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import linededup, mixing, ngramjoin, packing, toxicity
from barloom.llm.common import documents, keep
from barloom.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    score = "toxicity"
    while score in map(str.lower, docs.columns):  # a column of this name is the document's own
        score += "_"
    return toxicity.score_toxicity(docs, labels, out=score).where(F.col(score) < 0.5).select(*[f"`{c}`" for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, exact or within one edit."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8 or more."""
    ship(spark)
    return ngramjoin.one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: whole repeats of a document, and a part of chosen blocks."""
    return mixing.take_mixed(mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 words; repeats of a text never share a sequence."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near duplicates", drop_near_duplicates), ("source mix", mix), ("best-fit packing", pack)]

#: The toxicity model is learned, so SQL cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
