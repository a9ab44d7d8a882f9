"""Parameters of the signal research jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are those of the trading rules that the jobs evaluate."""

    zigzag_pct: float = 0.05  # a close this far from the candidate reverses the leg
    confirm_bars: int = 2  # bars after the reversal until a pivot may be used

    ratios: tuple[float, ...] = (0.236, 0.382, 0.500, 0.618, 0.786)
    proximity_pct: float = 0.005

    rsi_len: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    bb_len: int = 20
    bb_k: float = 2.0
    atr_len: int = 14
    vol_lookback: int = 50
    rsi_oversold: float = 35.0
    vol_z_threshold: float = 1.0

    atr_pct_min: float = 0.005
    atr_pct_max: float = 0.10

    min_confluence: int = 3
    hold_bars: int = 20
    stop_atr_mult: float = 1.5
    take_atr_mult: float = 2.5

    fee_bps: float = 5.0
    slippage_bps: float = 5.0

    annualization_factor: float = 252.0

    n_permutations: int = 1000
    random_ratio_low: float = 0.2
    random_ratio_high: float = 0.8
    random_seed: int = 42

    @property
    def cost(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 1e4


def level_name(ratio: float) -> str:
    return f"fib_{int(ratio * 1000):03d}"
