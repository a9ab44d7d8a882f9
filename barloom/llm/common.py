"""Helpers that the operators share: tables in the shared folder, the documents, row hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.scratch import forget as forget
from barloom.scratch import keep as keep
from barloom.session import ship

#: Characters that separate words: \x20 and \x09-\x0D. The rest of a text is words.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows: a batch then holds few megabytes even when some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id="doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_hash(df: DataFrame):
    """A hash of all columns of a row, to tell rows with the same id apart."""
    kinds = dict(df.dtypes)
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] else F.col(f"`{c}`") for c in sorted(df.columns)])
