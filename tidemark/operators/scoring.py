"""Scores, levels and states of a bar as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dialect import LEVELS, WATCH_SCORE, Dialect
from tidemark.functions.js import clamp, js_round


def funding_points(rate: Column, dialect: Dialect) -> Column:
    out = F.when(rate.isNull(), dialect.funding_null)
    for below, points in dialect.funding_steps:
        out = out.when(F.abs(rate) < below, points)
    return out.otherwise(2.0)


def aligned(direction: Column, strength: Column) -> Column:
    return F.when(direction == "LONG", strength >= -2).otherwise(strength <= 2)


def components(quality: Column, is_aligned: Column, volume: Column, strength: Column, open_interest: Column, funding: Column, dialect: Dialect, weighted_rr: Column, liquidity: Column) -> dict[str, Column]:
    """The terms of the score, in the order in which they are added; regime, trends and structure always confirm."""
    return {
        "quality_points": clamp(quality / 10, 0, 10),
        "aligned_points": F.when(is_aligned, 10.0).otherwise(4.0),
        "regime_points": F.lit(10.0),
        "trend_4h_points": F.lit(8.0),
        "trend_1h_points": F.lit(8.0),
        "structure_points": F.lit(14.0),
        "volume_points": clamp(volume / 2, 0, 1) * 8,
        "open_interest_points": F.when(open_interest.isNull(), 5.0).when(open_interest > 0, 8.0).otherwise(3.0),
        "funding_points": funding_points(funding, dialect),
        "strength_points": clamp(F.abs(strength), 0, 6),
        "liquidity_points": clamp(liquidity, 0, 5),
        "rr_points": F.when(weighted_rr >= 1.3, 5.0).otherwise(1.0),
    }


def score(terms: dict[str, Column]) -> Column:
    total = None
    for term in terms.values():
        total = term if total is None else total + term
    return js_round(clamp(total, 0, 100)).cast("int")


def level(points: Column) -> Column:
    out = None
    for name, least in LEVELS:
        out = F.when(points >= least, name) if out is None else out.when(points >= least, name)
    return out.otherwise("NONE")


def benchmark_state(strength: Column) -> Column:
    return F.when(strength >= 0, "weak_bull").otherwise("range")


def market_regime(volume: Column) -> Column:
    return F.when(volume >= 2, "expansion").otherwise("trend")


def lifecycle(eligible: Column, points: Column) -> Column:
    return F.when(eligible, "planned").when(points >= WATCH_SCORE, "watching").otherwise("detected")
