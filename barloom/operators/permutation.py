"""Permutation test: do the chosen ratios do better than random ones on the same swings?

Only `fib_near` depends on the ratios, so features and outcomes are computed once; the draws then only
re-select signals among the bars that can become one at all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.outcomes import trade_rows
from barloom.operators.signals import FLAGS, entry_signal
from barloom.params import Params


def random_draws(spark, p: Params = Params(), n: int | None = None) -> DataFrame:
    """draw_id, ratios: twice as many uniform ratios as needed, rounded to 3 places, distinct, sorted, the
    first of them; draws with too few are left out. Uniform numbers are 32 bits of an md5, as any engine has it."""
    size, span = len(p.ratios), p.random_ratio_high - p.random_ratio_low
    unit = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(p.random_seed)), F.col("id").cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    ratios = F.array_sort(F.array_distinct(F.array(*[F.round(p.random_ratio_low + span * unit(k), 3) for k in range(2 * size)])))
    d = spark.range(n if n is not None else p.n_permutations).select(F.col("id").alias("draw_id"), ratios.alias("all"))
    return d.where(F.size("all") >= size).select("draw_id", F.slice("all", 1, size).alias("ratios"))


def candidates(outcomes: DataFrame, p: Params = Params()) -> DataFrame:
    """Bars that a draw can turn into a signal: all conditions hold but nearness."""
    others = sum((F.col(k) for k in FLAGS[2:]), F.col(FLAGS[1]))
    d = outcomes.withColumn("other_flags", others).where("trend_up = 1 and regime_ok = 1 and swing_high is not null and entry_price is not null")
    return d.where(F.col("other_flags") >= p.min_confluence - 1).select("ticker", "bar_idx", "close", "swing_high", "swing_low", "atr", "trend_up", "regime_ok", "other_flags", "entry_price", "exit_price", "forward_return", "forward_bars", "barrier_touched", "nearest_fib_level")


def draw_table(spark, draws: DataFrame | list[tuple[int, list[float]]]) -> DataFrame:
    """draw_id, ratios."""
    return draws if isinstance(draws, DataFrame) else spark.createDataFrame(draws, "draw_id long, ratios array<double>")


#: Draws that are followed together: a ticker's candidates are dealt once for each such block.
DRAWS_AT_ONCE = 256


def draw_trades(cand: DataFrame, draws: DataFrame | list[tuple[int, list[float]]], p: Params = Params()) -> DataFrame:
    """Trades of every draw.

    The draws (`n_permutations` rows of a few numbers) are broadcast. A ticker's candidates pass in order, once per
    block of draws; each looks at all draws of the block at once: near are those with a ratio near its close, free those
    whose last trade is over. So no pairs of candidates and draws are made but the trades themselves, a ticker with many
    bars is several tasks, and memory is one batch and one number per draw."""
    table = draw_table(cand.sparkSession, draws).collect()  # a row a draw
    widest = max([len(r.ratios) for r in table], default=0)
    ids = np.array([r.draw_id for r in table], np.int64)
    ratios = np.array([[*r.ratios, *[np.nan] * (widest - len(r.ratios))] for r in table]).reshape(len(ids), widest)
    sent = cand.sparkSession.sparkContext.broadcast((ids, ratios))
    blocks = max(1, math.ceil(len(ids) / DRAWS_AT_ONCE))
    hits = cand.withColumns({"fib_near": F.lit(1), "confluence_count": F.col("other_flags") + 1})
    s = trade_rows(hits, entry_signal(p), ("ticker", "close", "swing_high", "swing_low"))
    rows = s.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = [c for c in s.columns if c not in ("close", "swing_high", "swing_low")]
    schema = s.select(F.lit(0).cast("long").alias("draw_id"), *names).schema

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ratios = sent.value
        last = some = free = None
        for b in batches:
            at, who = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            keys = zip(b.column("ticker").to_pylist(), b.column("block").to_pylist(), strict=True)
            close, high, low, start, end = (b.column(c).to_numpy(zero_copy_only=False) for c in ("close", "swing_high", "swing_low", "entry_idx", "exit_idx"))
            for i, key in enumerate(keys):
                if key != last:
                    last, some = key, slice(key[1] * DRAWS_AT_ONCE, (key[1] + 1) * DRAWS_AT_ONCE)
                    free = np.full(len(ids[some]), -1)
                level = high[i] - ratios[some] * (high[i] - low[i])
                near = (np.abs(close[i] - level) / close[i] < p.proximity_pct).any(1)
                taken = np.flatnonzero(near & (free < start[i] - 1))
                if len(taken):
                    free[taken] = end[i]
                    at.append(np.full(len(taken), i))
                    who.append(ids[some][taken])
            rows = b.select(names).take(pa.array(np.concatenate(at)))
            yield pa.record_batch([pa.array(np.concatenate(who)), *rows.columns], names=["draw_id", *names])

    return rows.repartition("ticker", "block").sortWithinPartitions("ticker", "block", "entry_idx").mapInArrow(pick, schema)


def draw_metrics(t: DataFrame, draws: DataFrame | list[tuple[int, list[float]]]) -> DataFrame:
    """draw_id, trades, avg_ret over all tickers; a draw without trades counts 0."""
    m = t.groupBy("draw_id").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("avg_ret"))
    every = draw_table(t.sparkSession, draws).select("draw_id")
    return every.join(m, "draw_id", "left").select("draw_id", F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("avg_ret", F.lit(0.0)).alias("avg_ret"))


def permutation_summary(draws: DataFrame, baseline: DataFrame, metric: str = "avg_ret") -> DataFrame:
    """One row. baseline: one row with `metric`; without baseline trades all results are null.

    The two-sided p-value is taken about the draws' mean; effect is (baseline - mean) / sd."""
    b = F.broadcast(baseline.select(F.col(metric).alias("baseline")))  # one row
    m = F.broadcast(draws.agg(F.avg(metric).alias("perm_mean"), F.stddev_samp(metric).alias("perm_std"), F.count(F.lit(1)).alias("n_perms")))  # one row
    x = draws.select(F.col(metric).alias("x")).join(b, F.lit(True)).join(m, F.lit(True))
    far = (F.abs(F.col("x") - F.col("perm_mean")) >= F.abs(F.col("baseline") - F.col("perm_mean"))).cast("double")
    return x.groupBy("baseline", "perm_mean", "perm_std", "n_perms").agg(F.avg(far).alias("p_value")).withColumn("effect", (F.col("baseline") - F.col("perm_mean")) / F.when(F.col("perm_std") > 0, F.col("perm_std")))


def cohens_d(n1, m1, s1, n2, m2, s2):
    """Effect of two groups from counts, means and sample deviations; null if either has under two rows."""
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (m1 - m2) / pooled)
