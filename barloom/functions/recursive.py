"""The sequential part of a ticker: exponential averages and confirmed swing pivots, in one pass
over rows sorted by ticker and bar.

Input: ticker, bar_idx, high, low, close (and more, which passes through). Adds ema_fast, ema_slow, macd,
macd_sig, macd_hist, rsi; pivot (1 low, -1 high, 0 none) and pivot_confirmed_at at the pivot's bar; and at
the bar where a pivot is confirmed: confirmed_pivot, confirmed_pivot_idx, confirmed_price (its low or high).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.params import Params


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    move = pd.Series(close).diff()
    up, down = (x.ewm(alpha=1 / n, adjust=False).mean() for x in (move.clip(lower=0), -move.clip(upper=0)))
    return (100.0 - 100.0 / (1.0 + up / (down + 1e-12))).to_numpy()


def pivots(close: np.ndarray, pct: float, confirm_bars: int) -> list[tuple[int, int, int]]:
    """(pivot bar, 1 or -1, confirmed bar), in order. The leg's extreme so far is the candidate (the later of
    equal ones); a close that is `pct` away from it makes it a pivot. Before the first leg bar 0 is the candidate."""
    out: list[tuple[int, int, int]] = []
    if not len(close):
        return out
    rising, at, best = 0, 0, float(close[0])
    for i, p in enumerate(close[1:].tolist(), 1):
        if rising > 0 and p >= best or rising < 0 and p <= best:
            at, best = i, p
        change = (p - best) / best
        if rising <= 0 and change >= pct:
            out.append((at, 1, i + confirm_bars))
            rising, at, best = 1, i, p
        elif rising >= 0 and -change >= pct:
            out.append((at, -1, i + confirm_bars))
            rising, at, best = -1, i, p
    return out


def in_utc(t: pa.Table) -> pa.Table:
    """Timestamps that pass through carry the session's time zone; what is returned must say UTC."""
    return t.cast(pa.schema([pa.field(f.name, pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f for f in t.schema]))


ADDED = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("ema_fast", "ema_slow", "macd", "macd_sig", "macd_hist", "rsi")]
    + [T.StructField("pivot", T.IntegerType()), T.StructField("pivot_confirmed_at", T.LongType()), T.StructField("confirmed_pivot", T.IntegerType()), T.StructField("confirmed_pivot_idx", T.LongType()), T.StructField("confirmed_price", T.DoubleType())]
)


#: Rows that a task passes on at once, more only if one key has more.
AT_ONCE = 100_000


def _starts(t: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Where the rows of each key begin, in a table sorted by the keys."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for c in by:
        x = t[c].combine_chunks()
        none = np.asarray(x.is_null())
        new |= np.asarray(pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), False)) | (none[1:] != none[:-1])
    return np.r_[0, np.flatnonzero(new) + 1] if t.num_rows else np.empty(0, np.int64)


def with_sequential(bars: DataFrame, p: Params = Params(), by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One exchange by ticker; many tickers pass through a call. A ticker's arrays must fit a task (16 bytes a bar and
    column)."""
    schema = T.StructType([*bars.schema.fields, *ADDED.fields])

    def added(t: pa.Table, starts: np.ndarray) -> pa.Table:
        n = t.num_rows
        closes, lows, highs = (t[c].to_numpy() for c in ("close", "low", "high"))
        out = np.full((6, n), np.nan)
        pivot, confirmed_at = np.zeros(n, np.int32), np.full(n, -1, np.int64)
        kind, idx, price = np.zeros(n, np.int32), np.full(n, -1, np.int64), np.full(n, np.nan)
        for a, z in zip(starts, np.r_[starts[1:], n], strict=True):
            close = closes[a:z]
            fast, slow = ema(close, p.macd_fast), ema(close, p.macd_slow)
            line = fast - slow
            signal = ema(line, p.macd_signal)
            out[:, a:z] = fast, slow, line, signal, line - signal, rsi(close, p.rsi_len)
            for at, sign, confirmed in pivots(close, p.zigzag_pct, p.confirm_bars):
                pivot[a + at], confirmed_at[a + at] = sign, confirmed
                if a + confirmed < z:
                    kind[a + confirmed], idx[a + confirmed], price[a + confirmed] = sign, at, (lows if sign > 0 else highs)[a + at]
        none = kind == 0
        arrays = [*[pa.array(c, from_pandas=True) for c in out], pa.array(pivot), pa.array(confirmed_at), pa.array(kind, mask=none), pa.array(idx, mask=none), pa.array(price, mask=none)]
        t = in_utc(t)
        for f, x in zip(ADDED.fields, arrays, strict=True):
            t = t.append_column(f.name, x)
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            starts = _starts(t, by)
            if len(starts) > 1:  # the last key may go on
                yield from added(t.slice(0, starts[-1]), starts[:-1]).combine_chunks().to_batches()
                held = t.slice(starts[-1]).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held) if len(starts) > 1 else n // 2  # of one long key so far: look again later
        if held:
            t = pa.Table.from_batches(held)
            yield from added(t, _starts(t, by)).combine_chunks().to_batches()

    return bars.repartition(*by).sortWithinPartitions(*by, "bar_idx").mapInArrow(run, schema)
