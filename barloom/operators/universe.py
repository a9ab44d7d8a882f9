"""The universe of tickers: liquidity statistics, filters, threshold sweeps, and coverage of the corpus."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as ind


def ticker_stats(bars: DataFrame, approximate: bool = False) -> DataFrame:
    """n_bars, median_close, median_dollar_volume, median_atr_pct (null under 15 bars), first_date, last_date."""
    d = bars.withColumn("true_range", ind.true_range()).withColumn("atr_pct", ind.atr(14) / F.col("close"))
    median = (lambda c: F.percentile_approx(c, 0.5)) if approximate else F.median
    out = d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), median("close").alias("median_close"), median(F.col("close") * F.col("volume")).alias("median_dollar_volume"), median("atr_pct").alias("median_atr_pct"), F.min("bar_ts").alias("first_date"), F.max("bar_ts").alias("last_date"))
    return out.withColumn("median_atr_pct", F.when(F.col("n_bars") >= 15, F.col("median_atr_pct")))


@dataclass(frozen=True)
class FilterSpec:
    min_bars: float = 252
    min_dollar_volume: float = 1e6
    min_close: float = 1.0
    min_atr_pct: float = 0.005
    max_atr_pct: float = 0.10

    def keep(self, stats: DataFrame) -> DataFrame:
        return stats.where(passes({k: F.lit(float(v)) for k, v in asdict(self).items()}))


def passes(spec: dict):
    """A null statistic fails."""
    c = F.col
    return F.coalesce((c("n_bars") >= spec["min_bars"]) & (c("median_dollar_volume") >= spec["min_dollar_volume"]) & (c("median_close") >= spec["min_close"]) & (c("median_atr_pct") >= spec["min_atr_pct"]) & (c("median_atr_pct") <= spec["max_atr_pct"]), F.lit(False))


def restrict(df: DataFrame, kept: DataFrame) -> DataFrame:
    return df.join(kept.select("ticker"), "ticker", "left_semi")


#: One dimension varies at a time, the others stay at the base.
DIMENSIONS = {
    "min_bars": (252, 504, 756, 1008, 1260),
    "min_dollar_volume": (0, 5e5, 1e6, 5e6, 2e7, 1e8),
    "min_close": (0, 1, 3, 5, 10, 30),
    "max_atr_pct": (0.20, 0.10, 0.05, 0.03, 0.02),
    "min_atr_pct": (0.0, 0.005, 0.01, 0.015),
}


def sweep(stats: DataFrame, per_ticker: DataFrame, metric: str = "sharpe_like", base: FilterSpec = FilterSpec(), dimensions: dict = DIMENSIONS) -> DataFrame:
    """dimension, threshold, n_tickers (kept ones with a metric), mean, median, p25, p75, share_positive.

    The specs are a literal array (a few dozen), exploded on the one row per ticker; specs that keep
    nothing stay, with 0 tickers."""
    specs = [(d, float(t), asdict(replace(base, **{d: t}))) for d, ts in dimensions.items() for t in ts]
    literal = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(t).alias("threshold"), *[F.lit(float(v)).alias(k) for k, v in s.items()]) for d, t, s in specs])
    m = stats.join(per_ticker.select("ticker", F.col(metric).alias("m")), "ticker").where("m is not null")
    m = m.withColumn("spec", F.explode(literal)).where(passes({k: F.col(f"spec.{k}") for k in asdict(base)}))
    got = m.groupBy("spec.dimension", "spec.threshold").agg(F.count(F.lit(1)).alias("n_tickers"), F.avg("m").alias("mean"), F.median("m").alias("median"), F.percentile("m", F.lit(0.25)).alias("p25"), F.percentile("m", F.lit(0.75)).alias("p75"), F.avg((F.col("m") > 0).cast("double")).alias("share_positive"))
    every = stats.sparkSession.createDataFrame([(d, t) for d, t, _ in specs], "dimension string, threshold double")
    return every.join(got, ["dimension", "threshold"], "left").withColumn("n_tickers", F.coalesce("n_tickers", F.lit(0).cast("long")))


def coverage(bars: DataFrame) -> DataFrame:
    """ticker, first_date, last_date, n_rows."""
    return bars.groupBy("ticker").agg(F.min("bar_ts").cast("date").alias("first_date"), F.max("bar_ts").cast("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))


def coverage_profile(cover: DataFrame) -> DataFrame:
    """One row: spans of first and last dates, quartiles of the row counts."""
    day = lambda c: F.unix_date(c)
    mid = lambda c: F.date_from_unix_date(F.floor(F.median(day(c))).cast("int"))
    q = lambda p: F.percentile("n_rows", F.lit(p))
    return cover.agg(
        F.count(F.lit(1)).alias("n_tickers"), F.min("first_date").alias("first_min"), mid("first_date").alias("first_median"), F.max("first_date").alias("first_max"), F.min("last_date").alias("last_min"), mid("last_date").alias("last_median"), F.max("last_date").alias("last_max"),
        F.min("n_rows").alias("rows_min"), q(0.25).alias("rows_p25"), q(0.5).alias("rows_median"), q(0.75).alias("rows_p75"), F.max("n_rows").alias("rows_max"),
    )


def survivorship(cover: DataFrame) -> DataFrame:
    """One row: how far first and last dates spread, and what that suggests."""
    spread = cover.agg(F.date_diff(F.max("first_date"), F.min("first_date")).alias("first_spread_days"), F.date_diff(F.max("last_date"), F.min("last_date")).alias("last_spread_days"))
    verdict = F.when((F.col("first_spread_days") < 30) & (F.col("last_spread_days") < 30), "likely biased").when(F.col("last_spread_days") > 365, "varied ends").otherwise("unclear")
    return spread.withColumn("verdict", verdict)


def short_history(cover: DataFrame, share: float = 0.3) -> DataFrame:
    """Tickers with under `share` of the median number of rows. The median is one row: a bound for the broadcast."""
    median = cover.agg(F.median("n_rows").alias("median_rows"))
    return cover.join(F.broadcast(median), F.col("n_rows") < share * F.col("median_rows"))


def dollar_volume(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.median(F.col("close") * F.col("volume")).alias("median_dollar_volume"))


def file_inventory(spark: SparkSession, path: str, suspicious: str = r"(?i)(_old|_bak|_copy|_tmp|_test)") -> DataFrame:
    """One row: files, their bytes, and names with a suspicious suffix. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return f.agg(F.count(F.lit(1)).alias("n_files"), F.min("length").alias("bytes_min"), F.median("length").alias("bytes_median"), F.max("length").alias("bytes_max"), F.sum("length").alias("bytes_total"), F.count_if(name.rlike(suspicious)).alias("n_suspicious"))
