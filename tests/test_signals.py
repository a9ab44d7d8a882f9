"""Invariants of swings, legs, outcomes and trades; values by hand."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import recursive
from barloom.functions.recursive import pivots, with_sequential
from barloom.operators import outcomes, panel, signals, universe
from barloom.params import Params
from barloom.sources import fixtures


def walk(n=600, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0008, 0.012, n)))
    close[100:110] *= np.linspace(1, 0.9, 10)
    open_ = np.r_[close[0], close[:-1]]
    return pd.DataFrame({"ticker": "A", "bar_idx": np.arange(n), "bar_ts": pd.date_range("2020-01-01", periods=n), "open": open_, "high": np.maximum(open_, close) * 1.005, "low": np.minimum(open_, close) * 0.995, "close": close, "volume": rng.integers(1000, 5000, n).astype(float)})


@pytest.fixture(scope="module")
def features(spark):
    return signals.prepare(spark.createDataFrame(pd.concat([walk(), walk(seed=3).assign(ticker="B")])), Params()).cache()


def test_equal_averages_are_no_trend(spark):
    """Prices that repeat every ten bars: averages over 20 and 50 bars are equal, whatever their sums round to."""
    t = walk(400, 5)
    again = 100 + np.array([0.11, 3.37, 1.53, 2.29, 0.71, 4.13, 3.91, 1.07, 2.83, 0.19])
    for c, f in (("open", 1.0), ("high", 1.01), ("low", 0.99), ("close", 1.0)):
        t[c] = np.r_[np.full(200, 80.0), np.resize(again, 200)] * f
    got = signals.prepare(spark.createDataFrame(t), Params()).where("bar_idx >= 250 and bar_idx < 390")
    assert got.where("ma50 > ma200").count() > 100 and got.where("trend_up = 1").count() == 0


def test_pivots_alternate_and_confirm_later():
    got = pivots(walk().close.to_numpy(), 0.05, 2)
    assert len(got) > 3
    assert all(a[1] == -b[1] for a, b in zip(got, got[1:], strict=False))
    assert all(c >= at + 2 for at, _, c in got)
    assert pivots(walk().close.to_numpy(), 9.0, 2) == [] and pivots(np.array([]), 0.05, 2) == []


def test_later_of_equal_extremes_is_the_pivot():
    assert pivots(np.array([100.0, 110, 110, 100]), 0.05, 2) == [(0, 1, 3), (2, -1, 5)]


def test_levels_by_hand(spark):
    d = spark.createDataFrame([(100.0, 200.0)], "swing_low double, swing_high double")
    r = signals.with_levels(d, (0.382, 0.5), extensions=True).first()
    assert (r.fib_382, r.fib_500, r.ext_1272) == pytest.approx((161.8, 150.0, 227.2))


def test_no_look_ahead(spark, features):
    """What is known at a bar does not change when later bars are cut off."""
    cols = ["swing_low", "swing_high", "nearest_fib_dist", "confluence_count"]
    cut = signals.prepare(spark.createDataFrame(walk().iloc[:400]), Params()).select("bar_idx", *cols).toPandas().sort_values("bar_idx")
    full = features.where("ticker = 'A' and bar_idx < 400").select("bar_idx", *cols).toPandas().sort_values("bar_idx")
    pd.testing.assert_frame_equal(cut.reset_index(drop=True), full.reset_index(drop=True))


def test_outcomes_truncate_at_the_end(features):
    o = outcomes.with_outcomes(features, Params()).where("ticker = 'A'").select("bar_idx", "label", "barrier_touched", "forward_bars").toPandas().set_index("bar_idx")
    assert np.isnan(o.label[599]) and o.barrier_touched[598] == "time" and o.forward_bars[598] == 0
    assert o.forward_bars.max() <= 20 and o.label[:12].isna().all()


def test_trades_do_not_overlap_and_costs_hurt(features):
    loose = Params(min_confluence=2)
    signal = F.col("atr").isNotNull() & (F.col("bar_idx") % 3 == 0)
    t = outcomes.trades(outcomes.with_outcomes(features, loose), signal).toPandas().sort_values(["ticker", "entry_idx"])
    for _, g in t.groupby("ticker"):
        assert (g.entry_idx.to_numpy()[1:] - 1 > g.exit_idx.to_numpy()[:-1]).all()
    costly = outcomes.trades(outcomes.with_outcomes(features, Params(fee_bps=50.0)), signal).toPandas()
    assert costly.ret.mean() < t.ret.mean()
    assert outcomes.trades(outcomes.with_outcomes(features, loose), F.col("confluence_count") > 6).count() == 0


def test_equity_survives_a_total_loss(spark):
    t = spark.createDataFrame([("A", 1, 0.5), ("A", 2, -1.0), ("A", 3, 0.1)], "ticker string, entry_idx long, ret double")
    assert [round(r.equity, 9) for r in outcomes.equity(t).orderBy("entry_idx").collect()] == [1.5, 0.0, 0.0]


def test_sweep_is_monotone(spark, sf):
    stats = universe.ticker_stats(fixtures.bars(spark, sf))
    per = stats.select("ticker", F.lit(1.0).alias("m"))
    n = {r.threshold: r.n_tickers for r in universe.sweep(stats, per, "m", universe.FilterSpec(min_dollar_volume=0), {"min_bars": (100, 520, 540, 9999)}).collect()}
    assert n[100] >= n[520] >= n[540] >= n[9999] == 0


def test_folds_are_disjoint_with_embargo(spark):
    for f in panel.expanding_folds(spark, 1000, 4, 20, 200).collect():
        assert f.train_end + 20 == f.test_start and f.train_start == 0
    sliding = panel.expanding_folds(spark, 2000, max_train=200).collect()
    assert all(f.train_end - f.train_start <= 200 for f in sliding) and sliding[-1].test_end == 2000
    starts = [f.test_start for f in panel.rolling_folds(spark, 200, min_train=100, step=5).orderBy("fold").collect()]
    assert starts == list(range(100, 200, 5))
    with pytest.raises(ValueError):
        panel.expanding_folds(spark, 100)


def test_no_leak_into_features(spark, features):
    cols = panel.feature_columns(outcomes.with_outcomes(features, Params()))
    assert {"rsi", "atr_pct", "confluence_count"} <= set(cols) and not panel.NOT_FEATURES & set(cols)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="volume"):
        signals.prepare(spark.createDataFrame(walk(120).drop(columns="volume")))


def test_sequential_keeps_rows(spark):
    b = spark.createDataFrame(walk(150))
    assert with_sequential(b).count() == 150


@pytest.mark.parametrize("at_once", [1, 70, 100_000])
def test_tickers_pass_together_as_alone(spark, monkeypatch, at_once):
    """Any number of rows a call, batches that cut tickers, two keys and null ones."""
    monkeypatch.setattr(recursive, "AT_ONCE", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rng = random.Random(4)
        close = {k: [100 * math.exp(sum(rng.gauss(0, 0.02) for _ in range(1)) + i * 0.001) for i in range(n)] for k, n in (("a", 150), ("b", 1), ("c", 200), (None, 90), ("e", 64))}
        rows = [(k, g, i, c * 1.01, c * 0.99, c) for k, cs in close.items() for g in (0, 1) for i, c in enumerate(cs[g * 7 :])]
        d = spark.createDataFrame(rows, "ticker string, grp int, bar_idx long, high double, low double, close double").repartition(3)
        got = recursive.with_sequential(d, by=("ticker", "grp")).toPandas()
        assert len(got) == len(rows)
        for (k, g), t in got.groupby(["ticker", "grp"], dropna=False):
            t = t.sort_values("bar_idx")
            c = t.close.to_numpy()
            assert np.allclose(t.ema_fast, recursive.ema(c, 12)) and np.allclose(t.rsi, recursive.rsi(c, 14), equal_nan=True)
            want = recursive.pivots(c, 0.05, 2)
            assert [(r.bar_idx, r.pivot, r.pivot_confirmed_at) for r in t[t["pivot"] != 0].itertuples()] == [(a, s, z) for a, s, z in sorted(want)]
            assert [(r.bar_idx, int(r.confirmed_pivot), int(r.confirmed_pivot_idx)) for r in t[t.confirmed_pivot.notna()].itertuples()] == [(z, s, a) for a, s, z in want if z < len(c)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
