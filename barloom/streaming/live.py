"""Live entry and exit decisions per ticker with Structured Streaming.

Bars wait in list state until the watermark has passed their time; an event-time timer then releases them in order, so
bars may arrive in any order within the allowed lateness. Later ones are dropped by the engine, which counts them
(numRowsDroppedByWatermark); a second bar of a time already decided is dropped and counted in the state. The state of a
ticker is typed and bounded: 220 closes, 50 volumes, 14 true ranges, the averages' last values, the swing and leg state,
the open position, and the waiting bars. A history table can be its initial state: it warms up and decides nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from barloom.operators.signals import TIE
from barloom.params import Params, level_name

DECISION = "ticker string, bar_ts timestamp, action string, price double, stop double, take double, confluence int, nearest_fib string, reason string"
COLUMNS = [x.split()[0] for x in DECISION.split(", ")]
#: A waiting bar: event time in microseconds and what it says.
BAR = "at long, open double, high double, low double, close double, volume double"
#: The state store that keeps typed state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WARM_UP = 220


def above(a: float, b: float) -> bool:
    """a > b, as the flags of a batch have it."""
    return a - b > TIE * abs(b)


@dataclass
class Live:
    """One ticker; its fields are the columns of its state. feed() takes the next bar and returns a decision or None."""

    n: int = 0
    last: int = -(1 << 62)  # time of the last bar decided, in microseconds
    repeated: int = 0  # bars dropped because their time was decided already
    timer: int | None = None
    closes: list = field(default_factory=list)
    volumes: list = field(default_factory=list)
    ranges: list = field(default_factory=list)
    fast: float | None = None
    slow: float | None = None
    signal: float | None = None
    up: float | None = None
    down: float | None = None
    rsi: float | None = None
    hist: float | None = None
    rising: int = 0
    at: int = 0
    best: float = 0.0
    extreme: list = field(default_factory=lambda: [0.0, 0.0])  # low and high of the candidate's bar
    pending: list = field(default_factory=list)  # confirmed bar, pivot bar, kind, price of each
    low: list | None = None  # bar and price of the last confirmed low
    leg: list | None = None  # low and high
    open: list | None = None  # stop, take, bars held

    def _swing(self, i: int, high: float, low: float, close: float, p: Params) -> None:
        if i == 0:
            self.best, self.extreme = close, [low, high]
            return
        if self.rising > 0 and close >= self.best or self.rising < 0 and close <= self.best:
            self.at, self.best, self.extreme = i, close, [low, high]
        change = (close - self.best) / self.best
        kind = 1 if self.rising <= 0 and change >= p.zigzag_pct else -1 if self.rising >= 0 and -change >= p.zigzag_pct else 0
        if kind:
            self.pending.append([float(i + p.confirm_bars), float(self.at), float(kind), self.extreme[0 if kind > 0 else 1]])
            self.rising, self.at, self.best, self.extreme = kind, i, close, [low, high]

    def _confirm(self, i: int) -> None:
        while self.pending and self.pending[0][0] <= i:
            _, at, kind, price = self.pending.pop(0)
            if kind > 0:
                self.low = [at, price]
            elif self.low and at > self.low[0] and price > self.low[1]:
                self.leg = [self.low[1], price]

    def feed(self, o: float, high: float, low: float, close: float, volume: float, p: Params) -> dict | None:
        i, self.n = self.n, self.n + 1
        before = self.closes[-1] if self.closes else None
        tr = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        for xs, x, most in ((self.closes, close, WARM_UP), (self.volumes, volume, p.vol_lookback), (self.ranges, tr, p.atr_len)):
            xs.append(x)
            del xs[:-most]
        step = lambda y, x, a: x if y is None else (1 - a) * y + a * x
        self.fast, self.slow = step(self.fast, close, 2 / (p.macd_fast + 1)), step(self.slow, close, 2 / (p.macd_slow + 1))
        line = self.fast - self.slow
        self.signal = step(self.signal, line, 2 / (p.macd_signal + 1))
        old_hist, self.hist, old_rsi = self.hist, line - self.signal, self.rsi
        if before is not None:
            move = close - before
            self.up, self.down = step(self.up, max(move, 0.0), 1 / p.rsi_len), step(self.down, max(-move, 0.0), 1 / p.rsi_len)
            self.rsi = 100 - 100 / (1 + self.up / (self.down + 1e-12))
        self._swing(i, high, low, close, p)
        self._confirm(i)
        if self.open:
            return self._exit(high, low, close, p)
        return self._enter(close, volume, old_hist, old_rsi, p) if self.n >= WARM_UP else None

    def _exit(self, high: float, low: float, close: float, p: Params) -> dict | None:
        stop, take, held = self.open
        self.open = [stop, take, held + 1]
        for hit, price, reason in ((low <= stop, stop, "stop_hit"), (high >= take, take, "take_hit"), (held + 1 >= p.hold_bars, close, "time_stop")):
            if hit:
                self.open = None
                return {"action": "exit", "price": price, "stop": stop, "take": take, "confluence": 0, "nearest_fib": "", "reason": reason}
        return None

    def _enter(self, close: float, volume: float, old_hist: float | None, old_rsi: float | None, p: Params) -> dict | None:
        if not self.leg or len(self.ranges) < p.atr_len:
            return None
        low, high = self.leg
        nearest = min((abs(close - (high - r * (high - low))) / close, k, f"dist_{level_name(r)}") for k, r in enumerate(p.ratios))
        atr = sum(self.ranges) / len(self.ranges)
        if not (nearest[0] < p.proximity_pct and p.atr_pct_min <= atr / close <= p.atr_pct_max):  # most bars
            return None
        c = np.array(self.closes)
        ma20, ma50, ma200 = (c[-n:].mean() for n in (20, 50, 200))
        trend = above(ma20, ma50) and above(ma50, ma200)
        window, volumes = c[-p.bb_len :], np.array(self.volumes)
        z = (volume - volumes.mean()) / (volumes.std(ddof=1) + 1e-12) if len(volumes) == p.vol_lookback else math.nan
        flags = [
            True, trend, old_rsi is not None and old_rsi < p.rsi_oversold and above(self.rsi, old_rsi), self.hist > 0 and old_hist is not None and self.hist > old_hist,
            close < (window.mean() - p.bb_k * window.std(ddof=1)) * 1.01, z > p.vol_z_threshold,
        ]
        count = sum(map(bool, flags))
        if not trend or count < p.min_confluence:
            return None
        a = max(atr, 1e-8)
        self.open = [close - p.stop_atr_mult * a, close + p.take_atr_mult * a, 0.0]
        return {"action": "enter_long", "price": close, "stop": self.open[0], "take": self.open[1], "confluence": count, "nearest_fib": nearest[2], "reason": "fib_confluence"}


_KINDS = {"int": "long", "int | None": "long", "float": "double", "float | None": "double", "list": "array<double>", "list | None": "array<double>"}
#: Columns of the state, one a field.
STATE = ", ".join(f"{f.name} {'array<array<double>>' if f.name == 'pending' else _KINDS[f.type]}" for f in fields(Live))


def replay(ticker: str, bars: list[tuple], live: Live, p: Params, new: bool = True) -> pd.DataFrame:
    """Feeds bars (see BAR) in order of time, those not after the last one dropped. History (not new) decides nothing."""
    out = []
    for at, *bar in sorted(bars):
        if at <= live.last:
            live.repeated += 1
            continue
        live.last = at
        d = live.feed(*bar, p)
        if not new:
            live.open = None
        elif d:
            out.append({"ticker": ticker, "bar_ts": pd.Timestamp(at, unit="us"), **d})
    return pd.DataFrame(out, columns=COLUMNS)


def bars_of(t: pd.DataFrame) -> list[tuple]:
    at = t.bar_ts.to_numpy().astype("datetime64[us]").astype(np.int64)
    return list(zip(at.tolist(), *[t[c].astype(float).tolist() for c in ("open", "high", "low", "close", "volume")], strict=True))


class Decide(StatefulProcessor):
    """Holds bars back until no earlier one can come, and decides them in order."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.waiting = handle.getValueState("live", STATE), handle.getListState("waiting", BAR)

    def _live(self) -> Live:
        return Live(*self.state.get()) if self.state.exists() else Live()

    def _save(self, live: Live) -> None:
        self.state.update(tuple(getattr(live, f.name) for f in fields(Live)))

    def _wake(self, live: Live, at: int | None) -> None:
        """One timer a ticker, for its earliest waiting bar."""
        due = None if at is None else at // 1000
        if due is not None and (live.timer is None or due < live.timer):
            if live.timer is not None:
                self.handle.deleteTimer(live.timer)
            self.handle.registerTimer(due)
            live.timer = due

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live, first = self._live(), None
        for t in rows:
            bars = bars_of(t)
            if bars:
                self.waiting.appendList(bars)
                first = min(first or bars[0][0], *[b[0] for b in bars])
        self._wake(live, first)
        self._save(live)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live, upto = self._live(), timerValues.getCurrentWatermarkInMs() * 1000
        bars = sorted(self.waiting.get())
        left = [b for b in bars if b[0] > upto]
        live.timer = None
        out = replay(key[0], [b for b in bars if b[0] <= upto], live, self.p)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self._wake(live, left[0][0] if left else None)
        self._save(live)
        yield out

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        live = self._live()
        replay(key[0], bars_of(initialState), live, self.p, new=False)
        self._save(live)


def _bars(df: DataFrame) -> DataFrame:
    return df.select("ticker", "bar_ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def live_decisions(bars: DataFrame, p: Params = Params(), late: str = "5 days", history: DataFrame | None = None) -> DataFrame:
    """Decisions from a stream of bars (bar_ts a timestamp). A bar is decided when the watermark passes it, so to flush
    the last ones send any later bar. history: a table of earlier bars that is the state to begin with.

    Sets the session's state store to RocksDB, the one that holds typed state."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    grouped = _bars(bars).withWatermark("bar_ts", late).groupBy("ticker")
    first = None if history is None else _bars(history).groupBy("ticker")
    return grouped.transformWithStateInPandas(statefulProcessor=Decide(p), outputStructType=DECISION, outputMode="Append", timeMode="EventTime", initialState=first)


def batch_decisions(bars: DataFrame, p: Params = Params(), history: DataFrame | None = None) -> DataFrame:
    """The same decisions from a table. history: bars that only warm the state up."""
    d = _bars(bars).withColumn("new", F.lit(True))
    if history is not None:
        d = d.unionByName(_bars(history).withColumn("new", F.lit(False)))

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        live = Live()
        replay(key[0], bars_of(t[~t.new]), live, p, new=False)
        return replay(key[0], bars_of(t[t.new]), live, p)

    return d.groupBy("ticker").applyInPandas(run, DECISION)
