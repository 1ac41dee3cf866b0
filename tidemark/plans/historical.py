"""The historical backtest: candles to trades to summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import GOOD_LEVELS, Dialect
from tidemark.operators import indicators, outcome, plan, schedule
from tidemark.operators.ordered import numbered


def evaluated_bars(candles: DataFrame, dialect: Dialect, benchmark: str) -> DataFrame:
    """Every bar from ``least_seq`` on, of all symbols but the benchmark, with its evaluation."""
    rows = indicators.features(candles, dialect, dialect.interval_ms)
    rows = indicators.with_benchmark(rows, benchmark)
    rows = rows.filter((F.col("symbol") != benchmark) & (F.col("seq") >= dialect.least_seq) & (F.col("benchmark_seq") >= dialect.least_seq))
    return plan.evaluated(rows, dialect)


def candidates(evaluations: DataFrame, dialect: Dialect) -> DataFrame:
    """Planned evaluations with a full horizon of bars after them."""
    return evaluations.filter(F.col("level").isin(*GOOD_LEVELS) & F.col("eligible") & (F.col("seq") < F.col("bars") - dialect.horizon))


CARRIED = ["symbol", "seq", "open_time", "direction", "level", "score", "entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3"]


def outcomes(candles: DataFrame, dialect: Dialect, benchmark: str) -> DataFrame:
    """Each candidate with its outcome; evaluated once for all polling steps."""
    chosen = candidates(evaluated_bars(candles, dialect, benchmark), dialect).select(*CARRIED)
    bars = numbered(candles).select("symbol", "seq", "high", "low")
    return outcome.simulated(chosen, bars, dialect.horizon, dialect)


def trades(candles: DataFrame, dialect: Dialect, benchmark: str) -> DataFrame:
    """Taken trades per polling step, in minutes."""
    rows = schedule.greedy(schedule.strided(outcomes(candles, dialect, benchmark), dialect), dialect.horizon)
    return rows.withColumn("polling_minutes", (F.col("step") * (dialect.interval_ms // 60_000)).cast("int"))
