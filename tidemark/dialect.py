"""The two rule sets of the engine, live and historical, as parameters of one implementation."""

from __future__ import annotations

from dataclasses import dataclass

HOUR = 3_600_000


@dataclass(frozen=True)
class Dialect:
    """Everything in which the rule sets differ, and what both take as given."""

    name: str
    closed_at_now: bool  # whether a bar that ends now is closed
    volume_bars: int  # previous bars that the volume base averages
    volume_default: float  # volume ratio without a base
    funding_null: float  # funding points without a rate
    funding_steps: tuple[tuple[float, float], ...]  # (below, points)
    plan_scale: float  # one over the rounding step of plan prices
    fee: float
    slippage: float = 0.0005
    quality_bars: int | None = None  # bars of the quality frame; None: all so far
    least_seq: int = 40  # first bar, from 0, that is evaluated
    horizon: int = 96
    steps: tuple[int, ...] = (1, 2, 4)
    interval_ms: int = 900_000
    summary_scale: float | None = 1e4  # one over the rounding step of summaries


LIVE = Dialect("live", False, 20, 1.0, 6.0, ((0.0005, 8.0), (0.001, 6.0), (0.002, 4.0)), 1e5, 0.001, quality_bars=120, least_seq=39, summary_scale=None)
HISTORICAL = Dialect("historical", True, 19, 0.0, 5.0, ((0.0002, 8.0), (0.0005, 5.0)), 1e4, 0.0004)

# Thresholds, weights and names that both rule sets share.
LEVELS = (("S", 88), ("A", 78), ("B", 65), ("C", 50))
GOOD_LEVELS = ("A", "S")
QUALITY_LEAST, WEIGHTED_RR_LEAST, WATCH_SCORE = 90, 1.3, 65
ATR_BARS, STRUCTURE_BARS, STRENGTH_BARS, DIRECTION_BARS = 14, 20, 16, 9
MAJORS = ("BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT")
ALERT_EXCLUDED = ("LINKUSDT", "AVAXUSDT")
DEFAULT_SYMBOLS = ("BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT", "LINKUSDT", "AVAXUSDT", "DOGEUSDT")
BENCHMARK = "BTCUSDT"
