"""The failure notebook: scored rows with outcome, context and what pushed the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = ("bar_ts", "close", "atr_pct", "rsi", "macd_hist", "trend_up", "regime_ok", "confluence_count", "fib_near", "nearest_fib_level", "nearest_fib_dist", "retracement_depth", "vol_z", "rsi_reversal", "macd_confirm", "bb_confirm", "vol_confirm")
KEYS = ("ticker", "bar_idx")


def mistake(label, pred):
    return F.when(label == 1, F.when(pred == 1, "TP").otherwise("FN")).otherwise(F.when(pred == 1, "FP").otherwise("TN"))


def build(features: DataFrame, scores: DataFrame | None = None, threshold: float = 0.5, only_failures: bool = False) -> DataFrame:
    """Rows with a score and a label. scores: (ticker, bar_idx, proba); None if `features` carries proba already,
    which saves the join."""
    d = features if scores is None else features.join(scores.select(*KEYS, "proba"), list(KEYS))
    d = d.where("proba is not null and label is not null").withColumn("pred", (F.col("proba") >= threshold).cast("int"))
    d = d.withColumn("mistake_type", mistake(F.col("label"), F.col("pred")))
    d = d.select(*KEYS, "proba", "pred", F.col("label").cast("int").alias("label"), "mistake_type", "forward_return", "barrier_touched", *[c for c in CONTEXT if c in features.columns])
    return d.where("mistake_type in ('FP', 'FN')") if only_failures else d


def attribution_rows(nb: DataFrame, budget: int = 10_000) -> DataFrame:
    """Keys to explain: all failures, and so many correct rows (in hashed order) that both fill the budget."""
    fail = F.col("mistake_type").isin("FP", "FN")
    failures = nb.where(fail).count()
    correct = nb.where(~fail).orderBy(order_of("ticker", "bar_idx"), *KEYS).limit(max(0, budget - failures))
    return nb.where(fail).select(*KEYS, "mistake_type").unionByName(correct.select(*KEYS, "mistake_type"))


def order_of(ticker: str, bar_idx: str):
    """A spread-out order that any SQL engine can compute."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", ticker, F.col(bar_idx).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1 << 31))


def top_attributions(long: DataFrame, k: int = 5) -> DataFrame:
    """long: (ticker, bar_idx, feature, value). top_pos_features and top_neg_features, such as a=+0.100;b=+0.050."""
    size = F.when(F.isnan("value"), F.lit(float("-inf"))).otherwise(-F.abs("value"))  # a key's features are few: one list each
    some = lambda sign: F.array_sort(F.collect_list(F.when(sign, F.struct(size.alias("size"), "feature", "value"))))
    text = lambda found: F.array_join(F.transform(F.slice(found, 1, k), lambda x: F.format_string("%s=%+.3f", x["feature"], x["value"])), ";")
    d = long.groupBy(*KEYS).agg(some(F.col("value") > 0).alias("up"), some(F.col("value") < 0).alias("down"))
    return d.select(*KEYS, text(F.col("up")).alias("top_pos_features"), text(F.col("down")).alias("top_neg_features"))


def mean_attribution(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"))


def mistake_counts(nb: DataFrame) -> DataFrame:
    return nb.groupBy("mistake_type").agg(F.count(F.lit(1)).alias("n"))


def mistake_returns(nb: DataFrame, kind: str = "FP") -> DataFrame:
    return nb.where(F.col("mistake_type") == kind).agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return").alias("mean_forward_return"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return").alias("mean_forward_return"), F.min("forward_return").alias("min_forward_return"))
