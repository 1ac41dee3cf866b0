"""The live scan: the latest closed bar of each symbol, and the signals that it raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import Dialect
from tidemark.functions.js import number_text
from tidemark.operators import indicators, plan
from tidemark.operators.ordered import numbered
from tidemark.operators.state import opportunity_id

# When a signal no longer holds.
INVALIDATION = ("15m 收盘跌破结构位", "价格远离入场区超过 1R", "数据质量低于 75")


def latest(candles: DataFrame, dialect: Dialect, benchmark: str, now_ms: int | None = None) -> DataFrame:
    """The evaluation of each symbol's last closed bar beside the benchmark's last one, without regard to their times."""
    now = None if now_ms is None else F.lit(now_ms)
    rows = indicators.features(candles.filter("is_closed"), dialect, dialect.interval_ms, now)
    rows = rows.filter(F.col("bars") > dialect.least_seq)
    last = rows.filter(F.col("seq") == F.col("bars") - 1)
    # one row, so a cross join is a projection
    base = last.filter(F.col("symbol") == benchmark).select(F.col("move").alias("benchmark_move"))
    out = last.filter(F.col("symbol") != benchmark).crossJoin(F.broadcast(base)).withColumn("relative_strength", F.col("move") - F.col("benchmark_move"))
    return plan.evaluated(out, dialect)


def scan(candles: DataFrame, newest: int = 120) -> DataFrame:
    """The newest bars of each symbol and interval, as a scan over several intervals fetches and stores them."""
    rows = numbered(candles, ["symbol", "interval"], "open_time")
    return rows.filter(F.col("seq") >= F.col("bars") - newest).drop("seq", "bars")


def signals(evaluations: DataFrame) -> DataFrame:
    """Evaluations as signals: reasons, rules, the opportunity they belong to; plan fields only where eligible."""
    out = evaluations.withColumns({
        "signal_type": F.lit("trend_pullback"),
        "reasons": plan.reasons(F.col("volume_ratio"), F.col("relative_strength"), F.col("quality")),
        "invalidation_rules": F.array(*map(F.lit, INVALIDATION)),
        "created_ms": F.col("close_time"),
    })
    out = out.withColumn("opportunity_id", opportunity_id(F.col("symbol"), F.col("direction"), F.col("signal_type"), F.col("market_regime")))
    out = out.withColumn("id", F.concat_ws("@", "opportunity_id", F.col("created_ms").cast("string")))
    # the price not to chase is kept as a rule of its own, also where the plan is dropped
    rule = F.create_map(F.lit("direction"), F.col("direction"), F.lit("noChasePrice"), number_text(F.col("no_chase_price")))
    out = out.withColumn("no_chase_rule", F.when(F.col("no_chase_price").isNotNull(), rule).otherwise(F.create_map().cast("map<string,string>")))
    return out.withColumns({c: F.when(F.col("eligible"), F.col(c)) for c in plan.PLAN_FIELDS})
