"""What happens after a bar: barrier outcomes, trades that do not overlap, and their performance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.params import Params
from barloom.sources.bars import require


def with_outcomes(df: DataFrame, p: Params = Params(), by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """label, barrier_touched, forward_return, forward_bars, entry_price, exit_price for entering after each bar.

    Entry at the next open; stop and take from this bar's atr; the bars after the entry bar are looked at, up
    to hold_bars; the stop wins ties; else the exit is at the last close in sight. A window's list of bars
    stands in for a range join; its length is bounded by hold_bars."""
    require(df, {"open", "high", "low", "close", "atr", *by}, "outcomes")
    w = Window.partitionBy(*by).orderBy("bar_idx")
    ahead = F.collect_list(F.struct("low", "high", "close")).over(w.rowsBetween(2, p.hold_bars + 1))
    d = df.withColumns({"ahead_": ahead, "open_": F.lead("open").over(w), "close_": F.lead("close").over(w)})
    d = d.withColumn("entry_", F.when((F.col("atr") > 0) & F.col("open_").isNotNull(), F.col("open_") * (1.0 + p.cost)))
    d = d.withColumns({"stop_": F.col("entry_") - p.stop_atr_mult * F.col("atr"), "take_": F.col("entry_") + p.take_atr_mult * F.col("atr")})
    d = d.withColumns({"s_": F.expr("array_position(transform(ahead_, b -> b.low <= stop_), true)"), "t_": F.expr("array_position(transform(ahead_, b -> b.high >= take_), true)")})
    known = F.col("entry_").isNotNull()
    hit = F.when(known, F.when((F.col("s_") > 0) & ((F.col("t_") == 0) | (F.col("s_") <= F.col("t_"))), "stop").when(F.col("t_") > 0, "take").otherwise("time"))
    d = d.withColumn("barrier_touched", hit)
    b = F.col("barrier_touched")
    last = F.coalesce(F.expr("get(ahead_, size(ahead_) - 1).close"), F.col("close_"))
    price = F.when(b == "stop", F.col("stop_")).when(b == "take", F.col("take_")).when(b == "time", last) * (1.0 - p.cost)
    bars = F.when(b == "stop", F.col("s_")).when(b == "take", F.col("t_")).when(b == "time", F.size("ahead_"))
    d = d.withColumns({"entry_price": F.col("entry_"), "exit_price": price, "forward_bars": bars.cast("long")})
    d = d.withColumn("forward_return", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price"))
    d = d.withColumn("label", F.when(known, ((b == "take") | ((b == "time") & (F.col("forward_return") > 0))).cast("double")))
    return d.drop("ahead_", "open_", "close_", "entry_", "stop_", "take_", "s_", "t_")


def trade_rows(outcomes: DataFrame, signal, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The trade that each signal would be."""
    return outcomes.where(signal & F.col("entry_price").isNotNull()).select(
        *by, (F.col("bar_idx") + 1).alias("entry_idx"), (F.col("bar_idx") + 1 + F.col("forward_bars")).alias("exit_idx"), "entry_price", "exit_price", F.col("forward_return").alias("ret"),
        F.col("forward_bars").alias("bars_held"), F.col("confluence_count").alias("confluence"), F.col("barrier_touched").alias("exit_reason"), F.col("nearest_fib_level").alias("nearest_fib"),
    )


def trades(outcomes: DataFrame, signal, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One position at a time: a signal counts only after the exit of the trade before it.

    Signals are few; they are filtered before they are grouped."""
    s = trade_rows(outcomes, signal, by)

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by("entry_idx")
        kept, free = [], -1
        for i, (start, end) in enumerate(zip(t["entry_idx"].to_pylist(), t["exit_idx"].to_pylist(), strict=True)):
            if start - 1 > free:
                kept.append(i)
                free = end
        return t.take(np.array(kept, np.int64))

    return s.groupBy(*by).applyInArrow(pick, s.schema)


def equity(trades: DataFrame, by: tuple[str, ...] = ("ticker",), start: float = 1.0) -> DataFrame:
    """Adds equity (running product of 1 + ret) and drawdown from its running maximum.

    The product is a sum of logarithms, with signs and zeros counted apart."""
    w = Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    growth = 1 + F.col("ret")
    logs = F.sum(F.when(growth != 0, F.ln(F.abs(growth))).otherwise(0.0)).over(w)
    sign = F.when(F.sum((growth == 0).cast("int")).over(w) > 0, 0).when(F.sum((growth < 0).cast("int")).over(w) % 2 == 1, -1).otherwise(1)
    t = trades.withColumn("equity", F.lit(start) * sign * F.exp(logs))
    return t.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1.0)


METRICS = ("win_rate", "avg_ret", "median_ret", "sharpe_like", "sortino_like", "max_drawdown", "cum_return", "profit_factor", "avg_bars_held")


def performance(trades: DataFrame, by: tuple[str, ...] = ("ticker",), p: Params = Params()) -> DataFrame:
    """One row per group that has trades."""
    r, root = F.col("ret"), float(np.sqrt(p.annualization_factor))
    losses = F.when(r < 0, r)
    lost = -F.sum(losses)
    return equity(trades, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_ret"), F.median(r).alias("median_ret"),
        (F.avg(r) / (F.stddev_samp(r) + 1e-12) * root).alias("sharpe_like"), F.when(F.count(losses) > 1, F.avg(r) / (F.stddev_samp(losses) + 1e-12) * root).alias("sortino_like"),
        F.min("drawdown").alias("max_drawdown"), (F.max_by("equity", "entry_idx") - 1.0).alias("cum_return"),
        F.when(lost > 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"), F.avg("bars_held").alias("avg_bars_held"),
    )


def summary(trades: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("ticker",), p: Params = Params()) -> DataFrame:
    """Six measures for every key; a key without trades has 0 of them and nulls."""
    some = performance(trades, by, p).select(*by, "trades", "win_rate", "avg_ret", "sharpe_like", "max_drawdown", "cum_return")
    return keys.join(some, list(by), "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def with_folds(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Test slices of a walk-forward: fold k from 0; the first slice and the rest after the last are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    size = F.floor(n / (n_splits + 1))
    return df.withColumn("fold", (F.floor(F.col("bar_idx") / F.when(size > 0, size)) - 1).cast("long")).where(F.col("fold").between(0, n_splits - 1))


def walk_forward(features: DataFrame, signal, n_splits: int = 5, p: Params = Params()) -> DataFrame:
    """Performance of each test slice on its own: exits stop at the slice's end; features come from before."""
    by = ("ticker", "fold")
    return performance(trades(with_outcomes(with_folds(features, n_splits), p, by), signal, by), by, p)


def headline(per_ticker: DataFrame, metric: str = "sharpe_like") -> DataFrame:
    return per_ticker.agg(F.count(F.lit(1)).alias("tickers_with_trades"), F.avg(metric).alias(f"mean_{metric}"), F.median(metric).alias(f"median_{metric}"))
