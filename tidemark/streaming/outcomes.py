"""Outcomes as a stream: signals meet the bars after them, whichever of both comes first.

Both streams are joined within an interval of time, so each keeps what the other may still need and
drops it once the watermarks have passed. A signal's bars are then gathered until no more can come,
and folded in order as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import Dialect
from tidemark.operators.outcome import folded

PLAN = ["symbol", "seq", "direction", "entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3"]


def outcomes(signals: DataFrame, bars: DataFrame, dialect: Dialect, late: str = "1 hour", slack: int = 4) -> DataFrame:
    """Each signal (PLAN, open_time in ms) with its outcome, once its horizon of bars (symbol, seq, open_time, high, low) has passed.

    Horizons count bars; in time one may take ``slack`` times as long, as bars can be missing. A signal
    comes out when both streams have gone on by that and ``late``; one with fewer bars than the horizon
    then has no outcome. A stream that has come to rest is moved on by later rows of a symbol of no use.
    """
    left = signals.select(*PLAN, F.timestamp_millis("open_time").alias("raised")).withWatermark("raised", late)
    right = bars.select(F.col("symbol").alias("_symbol"), F.col("seq").alias("_at"), "high", "low", F.timestamp_millis("open_time").alias("opened")).withWatermark("opened", late)
    span = F.expr(f"INTERVAL {dialect.horizon * dialect.interval_ms * slack // 1000} SECONDS")
    met = left.join(right, (F.col("symbol") == F.col("_symbol")) & (F.col("opened") > F.col("raised")) & (F.col("opened") <= F.col("raised") + span))
    met = met.filter((F.col("_at") > F.col("seq")) & (F.col("_at") <= F.col("seq") + dialect.horizon))
    bar = F.struct(F.col("_at").alias("at"), "high", "low")
    gathered = met.groupBy("raised", *PLAN).agg(F.array_sort(F.collect_list(bar)).alias("_bars"))
    return folded(gathered.filter(F.size("_bars") == dialect.horizon), PLAN, dialect)
