"""Indicators as window expressions. All share the window (ticker, bar_idx), so one sort serves them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_bar():
    return Window.partitionBy("ticker").orderBy("bar_idx")


def last_n(n: int, w=None):
    return (w or by_bar()).rowsBetween(-(n - 1), 0)


def full(value: Column, over: str | Column, n: int, w=None) -> Column:
    """`value` where the last n bars are all there, else null."""
    return F.when(F.count(over).over(last_n(n, w)) == n, value)


def moving_average(x: str | Column, n: int, w=None) -> Column:
    return full(F.avg(x).over(last_n(n, w)), x, n, w)


def rolling_std(x: str | Column, n: int, w=None) -> Column:
    return full(F.stddev_samp(x).over(last_n(n, w)), x, n, w)


def bollinger(n: int = 20, k: float = 2.0, x: str = "close", w=None) -> dict[str, Column]:
    mid, sd = moving_average(x, n, w), rolling_std(x, n, w)
    return {"bb_mid": mid, "bb_up": mid + k * sd, "bb_low": mid - k * sd}


def true_range(w=None) -> Column:
    before = F.lag("close").over(w or by_bar())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(n: int = 14, tr: str = "true_range", w=None) -> Column:
    """Simple mean of the true range, which must be a column (a window cannot hold another)."""
    return moving_average(tr, n, w)


def volume_z(n: int = 50, w=None) -> Column:
    return (F.col("volume") - moving_average("volume", n, w)) / (rolling_std("volume", n, w) + 1e-12)
