"""Project-wide constants (fixed values that results depend on)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Defaults:
    fees: float = 0.001
    init_cash: float = 10000.0
    size: float = 0.3
    min_trades: int = 30
    max_drawdown: float = 0.30
    sharpe_weight: float = 0.7
    return_weight: float = 0.3
    rejected_score: float = -999.0
    # cluster radius by number of parameter dimensions
    cluster_radius: dict[int, float] = field(
        default_factory=lambda: {2: 0.15, 3: 0.30, 4: 0.35, 5: 0.40}
    )
    n_windows: int = 10
    split_num: int = 7  # train share 7/10, kept as integers so the floors are exact
    split_den: int = 10
    n_trials: int = 200
    top_quantile: float = 0.70
    green_ratio: float = 0.70
    orange_ratio: float = 0.50
    robust_share: float = 0.5
    depth_pcts: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0)
    slippage_usd: tuple[int, ...] = (1_000, 5_000, 10_000, 50_000, 100_000)
    candles_per_request: int = 500


DEFAULTS = Defaults()

# Rows of one series that a single task sorts at a time. A block of OHLCV rows
# this long is a few MB, so a series of any length is spread over many tasks.
BLOCK_BARS = 65_536

# Rows per replay task and rows of run-up in which a replay synchronises.
REPLAY_BLOCK_BARS = 8_192
REPLAY_RUNUP_BARS = 1_024
COMBOS_PER_TASK = 4_200
