"""Alternative data: wide by metric, lagged by business days, joined as of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide(long: DataFrame, metrics: list[str]) -> DataFrame:
    """ticker, date and a column per metric: the last value that is not null, by seq."""
    some = long.where("value is not null and date is not null")
    return some.groupBy("ticker", "date").pivot("metric", metrics).agg(F.max_by("value", "seq"))


def business_days_later(date, n: int):
    """Weekend dates count from their Friday."""
    day = F.weekday(date)
    friday = F.date_sub(date, F.greatest(day - 4, F.lit(0)))
    return F.date_add(friday, (n + 2 * F.floor((F.least(day, F.lit(4)) + n) / 5)).cast("int"))


def lagged(wide_: DataFrame, release_lag: int = 1) -> DataFrame:
    """The date moved by the publication lag; other columns get the prefix alt_. Of several source dates that
    fall on one date the latest stays."""
    cols = [c for c in wide_.columns if c not in ("ticker", "date")]
    d = wide_.withColumn("source_date", F.col("date"))
    d = d.withColumn("date", business_days_later(F.col("date"), release_lag)) if release_lag > 0 else d
    last = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.desc("source_date"))) == 1
    return d.withColumn("last_", last).where("last_").select("ticker", "date", *[F.col(c).alias(f"alt_{c}") for c in cols])


def merge_asof(bars: DataFrame, alt: DataFrame, date: str = "bar_date") -> DataFrame:
    """Each bar with the whole alt row of the latest date not after it: union and a running last, so linear,
    and for all tickers at once."""
    cols = [c for c in alt.columns if c not in ("ticker", "date")]
    b = bars.select("ticker", F.col(date).alias("t_"), F.lit(1).alias("k_"), F.struct(*bars.columns).alias("bar_"))
    a = alt.select("ticker", F.col("date").alias("t_"), F.lit(0).alias("k_"), F.struct(*cols).alias("alt_"))
    w = Window.partitionBy("ticker").orderBy("t_", "k_").rowsBetween(Window.unboundedPreceding, 0)
    u = b.unionByName(a, allowMissingColumns=True).withColumn("alt_", F.last("alt_", ignorenulls=True).over(w)).where("k_ = 1")
    return u.select("bar_.*", "alt_.*")
