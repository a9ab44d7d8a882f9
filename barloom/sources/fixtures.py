"""Bars, alternative data and scores derived from the order tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import ship


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, bar_date, bar_ts, open, high, low, close, volume, bar_idx: one bar per supplier and ship date."""
    li = ship(spark).read.parquet(f"{sf_dir}/lineitem.parquet")
    step = F.round(F.col("l_discount") * 100).cast("long") - F.round(F.col("l_tax") * 100).cast("long") - 1
    d = li.groupBy(F.col("l_suppkey").alias("sk"), F.to_date("l_shipdate").alias("bar_date")).agg(F.sum(step).alias("step"), F.max("l_quantity").alias("mq"), F.min("l_quantity").alias("nq"), F.sum("l_quantity").alias("vol"))
    w = Window.partitionBy("sk").orderBy("bar_date")
    d = d.withColumn("cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    price = lambda c: F.round(F.lit(100.0) * F.exp(F.lit(0.003) * c), 4)
    d = d.withColumns({"close": price(F.col("cum")), "open": price(F.coalesce(F.lag("cum").over(w), F.col("cum"))), "bar_idx": F.row_number().over(w).cast("long") - 1})
    return d.select(
        F.concat(F.lit("S"), F.lpad(F.col("sk").cast("string"), 5, "0")).alias("ticker"), "bar_date", F.col("bar_date").cast("timestamp").alias("bar_ts"), "open",
        F.round(F.greatest("open", "close") * (F.lit(1 + 0.001) + F.lit(0.00028) * F.col("mq")), 4).alias("high"),
        F.round(F.least("open", "close") * (F.lit(1 - 0.001) - F.lit(0.00028) * F.col("nq")), 4).alias("low"), "close", (F.col("vol") * 100).cast("double").alias("volume"), "bar_idx",
    )


METRICS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


def altdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, metric, value, seq from orders."""
    o = ship(spark).read.parquet(f"{sf_dir}/orders.parquet")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    metric = F.coalesce(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[F.col("o_orderpriority")], F.lit("other"))
    return o.select(F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % n).cast("string"), 5, "0")).alias("ticker"), F.to_date("o_orderdate").alias("date"), metric.alias("metric"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("seq"))


def score():
    """A probability that SQL can compute, in place of a model's."""
    return 1 / (1 + F.exp(2 - F.col("confluence_count")))

