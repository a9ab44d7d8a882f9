"""Legs, levels, flags and the entry signal: all window and column expressions over (ticker, bar_idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.recursive import with_sequential
from barloom.params import Params, level_name
from barloom.sources.bars import require


def with_active_leg(df: DataFrame) -> DataFrame:
    """swing_low, swing_high: the last up-leg that is known at a bar. A leg is made when a high is confirmed
    whose bar comes after that of the last confirmed low, and stays until the next one. The events stand on
    the bars where they are confirmed, so nothing looks ahead, and no join is needed."""
    require(df, {"confirmed_pivot", "confirmed_pivot_idx", "confirmed_price"}, "legs")
    so_far = ind.by_bar().rowsBetween(Window.unboundedPreceding, 0)
    low = F.last(F.when(F.col("confirmed_pivot") == 1, F.struct(F.col("confirmed_price").alias("price"), F.col("confirmed_pivot_idx").alias("idx"))), ignorenulls=True).over(so_far)
    df = df.withColumn("low_", low)
    valid = (F.col("confirmed_pivot") == -1) & (F.col("confirmed_pivot_idx") > F.col("low_.idx")) & (F.col("confirmed_price") > F.col("low_.price"))
    leg = F.last(F.when(valid, F.struct(F.col("low_.price").alias("low"), F.col("confirmed_price").alias("high"))), ignorenulls=True).over(so_far)
    return df.withColumn("leg_", leg).withColumns({"swing_low": F.col("leg_.low"), "swing_high": F.col("leg_.high")}).drop("leg_", "low_")


def with_levels(df: DataFrame, ratios: tuple[float, ...], extensions: bool = False) -> DataFrame:
    """A column fib_... for each ratio of the leg; with extensions, two levels above it."""
    size = F.col("swing_high") - F.col("swing_low")
    new = {level_name(r): F.col("swing_high") - r * size for r in ratios}
    if extensions:
        new |= {"ext_1272": F.col("swing_high") + 0.272 * size, "ext_1618": F.col("swing_high") + 0.618 * size}
    return df.withColumns(new)


def level_array(ratios):
    """For any set of ratios: array of (ratio, level)."""
    return F.transform(ratios, lambda r: F.struct(r.alias("ratio"), (F.col("swing_high") - r * (F.col("swing_high") - F.col("swing_low"))).alias("level")))


def with_distances(df: DataFrame, ratios: tuple[float, ...]) -> DataFrame:
    """dist_<level>, nearest_fib_dist, nearest_fib_level (the first of equal ones), retracement_depth."""
    names = [level_name(r) for r in ratios]
    df = df.withColumns({f"dist_{c}": F.abs(F.col("close") - F.col(c)) / F.col("close") for c in names})
    best = F.array_min(F.array(*[F.struct(F.col(f"dist_{c}").alias("d"), F.lit(i).alias("i"), F.lit(f"dist_{c}").alias("name")) for i, c in enumerate(names)]))
    some = F.col(f"dist_{names[0]}").isNotNull()
    size = F.col("swing_high") - F.col("swing_low")
    return df.withColumns({"nearest_fib_dist": F.when(some, best["d"]), "nearest_fib_level": F.when(some, best["name"]), "retracement_depth": F.when(size > 0, (F.col("swing_high") - F.col("close")) / size)})


def with_indicators(df: DataFrame, p: Params = Params()) -> DataFrame:
    df = df.withColumn("true_range", ind.true_range())
    df = df.withColumns({**{f"ma{n}": ind.moving_average("close", n) for n in (20, 50, 200)}, **ind.bollinger(p.bb_len, p.bb_k), "atr": ind.atr(p.atr_len), "vol_z": ind.volume_z(p.vol_lookback)})
    return df.withColumn("atr_pct", F.col("atr") / F.col("close")).drop("true_range")


#: Values that differ by less than this share of them are equal: sums of the same prices in another order differ so little.
TIE = 1e-12


def above(a, b):
    """a > b, where what rounding adds to equal averages does not count."""
    return a - b > TIE * F.abs(b)


FLAGS = ("fib_near", "trend_up", "rsi_reversal", "macd_confirm", "bb_confirm", "vol_confirm")


def with_flags(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Flags are 0 or 1; a null operand gives 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    c = F.col
    before = {k: F.lag(k).over(ind.by_bar()) for k in ("rsi", "macd_hist")}
    df = df.withColumns({
        "trend_up": flag(above(c("ma20"), c("ma50")) & above(c("ma50"), c("ma200"))),
        "rsi_reversal": flag((before["rsi"] < p.rsi_oversold) & above(c("rsi"), before["rsi"])),
        "macd_confirm": flag((c("macd_hist") > 0) & (c("macd_hist") - before["macd_hist"] > 0)),
        "bb_confirm": flag(c("close") < c("bb_low") * 1.01),
        "vol_confirm": flag(c("vol_z") > p.vol_z_threshold),
        "fib_near": flag(c("nearest_fib_dist") < p.proximity_pct),
        "regime_ok": flag(c("atr_pct").between(p.atr_pct_min, p.atr_pct_max)),
    })
    return df.withColumn("confluence_count", sum((c(k) for k in FLAGS[1:]), c(FLAGS[0])))


def entry_signal(p: Params = Params(), near="fib_near", count="confluence_count"):
    c = F.col
    return F.coalesce((c(near) == 1) & (c(count) >= p.min_confluence) & (c("trend_up") == 1) & (c("regime_ok") == 1) & c("atr").isNotNull(), F.lit(False))


def prepare(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """Bars with everything above. Two exchanges by ticker: into the sequential pass, and after it."""
    require(bars, {"ticker", "bar_idx", "open", "high", "low", "close", "volume"}, "features")
    df = with_indicators(with_active_leg(with_sequential(bars, p)), p)
    return with_flags(with_distances(with_levels(df, p.ratios), p.ratios), p)
