"""Live decisions: the stream against features computed in batch, arrival in any order, late bars, warm state."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import signals
from barloom.params import Params
from barloom.scratch import new_path
from barloom.sources import fixtures
from barloom.streaming import live

COLS = ["ticker", "bar_ts", "open", "high", "low", "close", "volume"]
P = Params(min_confluence=2)


def run(spark, parts, late="5 days", history=None):
    """What is decided when the parts (tables) arrive one after another, and the rows dropped as late."""
    source, sink, state = (new_path(spark, n) for n in ("bars", "decisions", "state"))
    dropped = 0
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        q = live.live_decisions(stream, P, late=late, history=history).writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += sum(o["numRowsDroppedByWatermark"] for x in q.recentProgress for o in x["stateOperators"])
    return spark.read.schema(live.DECISION).parquet(sink).toPandas().sort_values(["ticker", "bar_ts", "action"]).reset_index(drop=True), dropped


def wanted(spark, bars, first=219):
    """Decisions from the batch features, bar for bar."""
    d = signals.prepare(bars, P).withColumn("entry", signals.entry_signal(P)).select(*COLS, "bar_idx", "atr", "entry", "confluence_count", "nearest_fib_level").toPandas()
    out = []
    for ticker, t in d.sort_values("bar_idx").groupby("ticker"):
        stop = take = held = None
        for r in t.itertuples():
            if stop is not None:
                held += 1
                why = "stop_hit" if r.low <= stop else "take_hit" if r.high >= take else "time_stop" if held >= P.hold_bars else None
                if why:
                    out.append((ticker, r.bar_ts, "exit", {"stop_hit": stop, "take_hit": take, "time_stop": r.close}[why], why))
                    stop = None
            elif r.entry and r.bar_idx >= first:
                stop, take, held = r.close - P.stop_atr_mult * r.atr, r.close + P.take_atr_mult * r.atr, 0
                out.append((ticker, r.bar_ts, "enter_long", r.close, "fib_confluence"))
    return pd.DataFrame(out, columns=["ticker", "bar_ts", "action", "price", "reason"]).sort_values(["ticker", "bar_ts", "action"]).reset_index(drop=True)


def same(got, want):
    assert len(want) > 10
    pd.testing.assert_frame_equal(got[["ticker", "bar_ts", "action", "reason"]].astype(str), want[["ticker", "bar_ts", "action", "reason"]].astype(str))
    assert got.price.tolist() == pytest.approx(want.price.tolist(), rel=1e-9)


@pytest.fixture(scope="module")
def bars(spark, sf):
    b = fixtures.bars(spark, sf).cache()
    some = [r.ticker for r in b.select("ticker").distinct().orderBy("ticker").limit(4).collect()]
    return b.where(F.col("ticker").isin(some)).cache()


def beat(spark, bars):
    return bars.agg((F.max("bar_ts") + F.expr("interval 1 year")).alias("bar_ts"), *[F.lit(1.0).alias(c) for c in COLS[2:]]).select(F.lit("").alias("ticker"), *COLS[1:])


def test_shuffled_arrival_decides_as_the_batch_features_say(spark, bars):
    rng = random.Random(2)
    days = sorted(r.bar_ts for r in bars.select("bar_ts").distinct().collect())
    cuts = [days[0], days[len(days) // 3], days[2 * len(days) // 3]]
    rows = [tuple(r) for r in bars.select(*COLS).collect()]
    part = lambda ts: sum(ts >= c for c in cuts[1:])
    early = {r for r in rows if part(r[1]) < 2 and any(0 < (c - r[1]).days <= 8 for c in cuts[1:]) and rng.random() < 0.7}  # arrive with the next part
    parts = [[r for r in rows if part(r[1]) + (r in early) == k] for k in range(3)]
    for p in parts:
        rng.shuffle(p)
    frames = [spark.createDataFrame(p, bars.select(*COLS).schema) for p in parts]
    got, dropped = run(spark, [*frames, beat(spark, bars)], late="10 days")
    assert early and dropped == 0
    same(got, wanted(spark, bars))


def test_later_bars_are_counted_as_dropped(spark, bars):
    cut = F.col("bar_ts") < F.lit("1998-01-01").cast("timestamp")
    late = bars.where("bar_idx < 2").select(*COLS)
    n = late.count()
    got, dropped = run(spark, [bars.where(cut).select(*COLS), bars.where(~cut).select(*COLS).unionByName(late), beat(spark, bars)])
    assert n > 0 and dropped == n
    same(got, wanted(spark, bars))


def test_history_is_the_state_to_begin_with(spark, bars):
    before = F.col("bar_idx") < 300
    got, _ = run(spark, [bars.where(~before).select(*COLS).unionByName(beat(spark, bars))], history=bars.where(before).select(*COLS))
    same(got, wanted(spark, bars, first=300))
    batch = live.batch_decisions(bars.where(~before), P, history=bars.where(before)).toPandas().sort_values(["ticker", "bar_ts", "action"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, batch)
