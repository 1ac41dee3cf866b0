"""Trading plans and the evaluation of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import GOOD_LEVELS, QUALITY_LEAST, WEIGHTED_RR_LEAST, Dialect
from tidemark.functions.js import fixed_text, js_round, number_text, ratio
from tidemark.operators import scoring

#: Risk-reward ratios: to the third target, weighted over the targets, and after costs.
THEORETICAL_RR = 3.0
WEIGHTED_RR = 0.4 * 1 + 0.4 * 2 + 0.2 * 3
COST_RR = WEIGHTED_RR - 0.12
PLAN_FIELDS = ("entry_mode", "entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "theoretical_rr", "weighted_rr", "cost_adjusted_rr", "sl_distance_pct", "sl_atr_ratio", "no_chase_price")


def build(direction: Column, price: Column, atr: Column, low: Column, high: Column, scale: float) -> dict[str, Column]:
    """The fields of a plan: stop beyond the structure, entry around the price, targets at multiples of the risk."""
    long = direction == "LONG"
    pick = lambda a, b: F.when(long, a).otherwise(b)
    rounded = lambda x: js_round(x, scale)
    stop = pick(low - atr * 0.3, high + atr * 0.3)
    risk = pick(price - stop, stop - price)
    entry_low, entry_high = price - atr * pick(F.lit(0.15), F.lit(0.35)), price + atr * pick(F.lit(0.35), F.lit(0.15))
    target = lambda k: rounded(pick(price + risk * k, price - risk * k))
    return {
        "entry_mode": F.lit("pullback_limit"),
        "entry_low": rounded(entry_low),
        "entry_high": rounded(entry_high),
        "stop_loss": rounded(stop),
        "tp1": target(1),
        "tp2": target(2),
        "tp3": target(3),
        "theoretical_rr": F.lit(THEORETICAL_RR),
        "weighted_rr": F.lit(WEIGHTED_RR),
        "cost_adjusted_rr": F.lit(COST_RR),
        "sl_distance_pct": rounded(F.abs(ratio(price - stop, price)) * 100),
        "sl_atr_ratio": rounded(ratio(F.abs(price - stop), atr)),
        "no_chase_price": rounded(pick(entry_high + risk, entry_low - risk)),
    }


def no_chase(direction: Column, price: Column, entry_low: Column, entry_high: Column, stop: Column) -> Column:
    """Whether the price has run too far from the entry, or the plan has no risk to measure by."""
    long = direction == "LONG"
    risk = F.when(long, entry_high - stop).otherwise(stop - entry_low)
    return (risk <= 0) | F.when(long, price > entry_high + risk).otherwise(price < entry_low - risk)


def evaluated(rows: DataFrame, dialect: Dialect, circuit_breaker: bool = False) -> DataFrame:
    """Bars with relative strength become evaluations: score, level, states, plan fields, eligibility.

    Optional columns open_interest_change, funding_rate and liquidity_score are used where present.
    """
    optional = lambda name, kind, default=None: F.col(name) if name in rows.columns else F.lit(default).cast(kind)
    is_aligned = scoring.aligned(F.col("direction"), F.col("relative_strength"))
    terms = scoring.components(F.col("quality"), is_aligned, F.col("volume_ratio"), F.col("relative_strength"), optional("open_interest_change", "double"), optional("funding_rate", "double"), dialect, F.lit(WEIGHTED_RR), optional("liquidity_score", "double", 5.0))
    plan = build(F.col("direction"), F.col("close"), F.col("atr"), F.col("structure_low"), F.col("structure_high"), dialect.plan_scale)
    out = rows.withColumns({**plan, "score": scoring.score(terms)})
    out = out.withColumn("level", scoring.level(F.col("score")))
    out = out.withColumn("no_chase", no_chase(F.col("direction"), F.col("close"), F.col("entry_low"), F.col("entry_high"), F.col("stop_loss")))
    eligible = F.col("level").isin(*GOOD_LEVELS) & (F.col("quality") >= QUALITY_LEAST) & (F.col("weighted_rr") >= WEIGHTED_RR_LEAST) & ~F.col("no_chase") & ~F.lit(circuit_breaker)
    out = out.withColumn("eligible", eligible)
    return out.withColumns({"lifecycle_status": scoring.lifecycle(F.col("eligible"), F.col("score")), "btc_state": scoring.benchmark_state(F.col("relative_strength")), "market_regime": scoring.market_regime(F.col("volume_ratio"))})


# The wording of reasons.
QUALITY_TEXT, VOLUME_TEXT, STRONGER_TEXT, WEAKER_TEXT = ("数据质量 ", ""), ("成交额放大 ", " 倍"), ("相对 BTC 走强 ", "%"), ("相对 BTC 走弱 ", "%")


def reasons(volume: Column, strength: Column, quality: Column) -> Column:
    """Why a signal was raised: the quality always, volume from twice the base on, strength unless it is 0."""
    said = lambda text, value: F.concat(F.lit(text[0]), value, F.lit(text[1]))
    return F.array_compact(
        F.array(
            said(QUALITY_TEXT, number_text(quality)),
            F.when(volume >= 2, said(VOLUME_TEXT, fixed_text(volume, 2))),
            F.when(strength > 0, said(STRONGER_TEXT, fixed_text(strength, 2))),
            F.when(strength < 0, said(WEAKER_TEXT, fixed_text(strength, 2))),
        )
    )
