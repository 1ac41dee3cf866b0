"""Risk rules and market metrics that only declarations of the engine name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.js import js_round, pct_change
from tidemark.operators.ordered import blocked, numbered, running

DAY = 86_400_000
# What the declared rules say.
BREAKER_TRADES, BREAKER_LEAST, STOPS_IN_A_ROW, QUALITY_LEAST = 10, -0.3, 5, 75
HORIZONS = {"10m": 600_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000}


def circuit_breaker(trades: DataFrame, bars: int = BREAKER_TRADES, least: float = BREAKER_LEAST) -> DataFrame:
    """Per trade, whether the mean result of the last ``bars`` ones of its level and symbol has fallen below ``least``."""
    keys = ["step", "symbol", "level"]
    rows = blocked(numbered(trades, keys, "seq", 4096, "_place", "_of"), bars, place="_place")
    w = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(-(bars - 1), 0)
    rows = rows.withColumn("paused", (F.count("*").over(w) == bars) & (F.avg("final_r").over(w) < least))
    return rows.filter("own").drop("own", "block", "_place", "_of")


def market_breaker(trades: DataFrame, bars: int = BREAKER_TRADES, least: float = BREAKER_LEAST, chunk: int = 4096 * 900_000) -> DataFrame:
    """Per trade, whether the mean result of the last ``bars`` trades of its level, of all symbols by time and then by symbol, has fallen below ``least``.

    A level's trades of all symbols are one series, numbered by chunks of time and looked at in blocks.
    """
    keys = ["step", "level"]
    rows = blocked(numbered(trades, keys, "open_time", chunk, "_place", "_of", ("symbol",)), bars, place="_place")
    w = Window.partitionBy(*keys, "block").orderBy("_place").rowsBetween(-(bars - 1), 0)
    rows = rows.withColumn("paused", (F.count("*").over(w) == bars) & (F.avg("final_r").over(w) < least))
    return rows.filter("own").drop("own", "block", "_place", "_of")


def stops_in_a_row(trades: DataFrame) -> DataFrame:
    """``trades`` with stops, how many up to this one were stopped out without another result between, per step and symbol."""
    keys = ["step", "symbol"]
    lost = F.col("final_status") == "hit_sl"
    rows = trades.withColumn("_piece", F.floor(F.col("seq") / 4096))
    # trades so far, and how many there were at the last one that was not stopped out
    rows = running(rows, keys, ["seq"], ["_piece"], {"_n": ("sum", F.lit(1))})
    rows = running(rows, keys, ["seq"], ["_piece"], {"_other": ("max", F.when(~lost, F.col("_n")))})
    return rows.withColumn("stops", F.col("_n") - F.coalesce("_other", F.lit(0))).drop("_piece", "_n", "_other")


def guarded(rows: DataFrame, stops: Column, wild: Column, quality: Column) -> DataFrame:
    """``rows`` with what the declared rules allow: ``only_strong`` after STOPS_IN_A_ROW stops, ``alerts_only`` while the benchmark is wild, ``symbol_paused`` below QUALITY_LEAST."""
    return rows.withColumns({"only_strong": stops >= STOPS_IN_A_ROW, "alerts_only": wild, "symbol_paused": quality < QUALITY_LEAST})


def excursions(rows: DataFrame, bars: dict[str, int]) -> DataFrame:
    """The largest rise and fall in percent within the next bars of each horizon; ``rows`` has symbol, seq, close, high, low."""
    return _excursions(rows, bars, "seq", lambda w, n: w.rowsBetween(1, n))


def excursions_after(rows: DataFrame, spans: dict[str, int] = HORIZONS) -> DataFrame:
    """The largest rise and fall in percent within the next span of time (ms) of each horizon; ``rows`` has symbol, open_time, close, high, low."""
    return _excursions(rows, spans, "open_time", lambda w, span: w.rangeBetween(1, span))


def _percent(step: Column, of: Column) -> Column:
    """A step in percent to four decimals; of a price of zero it is infinite, and not a number where there is no step."""
    endless = F.when(step > 0, float("inf")).when(step < 0, float("-inf")).when(step == 0, float("nan"))
    return F.when(of == 0, endless).otherwise(js_round(step / of * 100, 1e4))


def _excursions(rows: DataFrame, horizons: dict[str, int], place: str, frame) -> DataFrame:
    longest = max(horizons.values())
    rows = blocked(rows, 0, max(4096, 64 * longest), longest, place)
    w = Window.partitionBy("symbol", "block").orderBy(place)
    for name, n in horizons.items():
        ahead = frame(w, n)
        rows = rows.withColumns({
            f"max_profit_pct_{name}": _percent(F.max("high").over(ahead) - F.col("close"), F.col("close")),
            f"max_loss_pct_{name}": _percent(F.col("close") - F.min("low").over(ahead), F.col("close")),
        })
    return rows.filter("own").drop("own", "block")


def change(rows: DataFrame, value: str, spans: dict[str, int]) -> DataFrame:
    """Per row the change of ``value`` in percent against the symbol's row exactly one span (ms) before; null where there is none."""
    for name, span in spans.items():
        past = rows.select("symbol", (F.col("open_time") + span).alias("open_time"), F.col(value).alias("_past"))
        rows = rows.join(past, ["symbol", "open_time"], "left").withColumn(f"{value}_change_{name}", F.when(F.col("_past").isNotNull(), js_round(pct_change(F.col("_past"), F.col(value)), 1e4))).drop("_past")
    return rows


def strength_over(rows: DataFrame, benchmark: str, spans: dict[str, int]) -> DataFrame:
    """Relative strength over several spans: a symbol's change of close less the benchmark's at the same time."""
    moved = change(rows, "close", spans)
    names = [f"close_change_{name}" for name in spans]
    base = moved.filter(F.col("symbol") == benchmark).select("open_time", *(F.col(n).alias(f"_{n}") for n in names))
    out = moved.join(base, "open_time").withColumns({f"strength_{name}": F.col(n) - F.col(f"_{n}") for name, n in zip(spans, names, strict=True)})
    return out.drop(*names, *(f"_{n}" for n in names))


#: The share of the price that the mean true range must reach for the benchmark to count as wild.
WILD = 0.05


def benchmark_trend(fast: DataFrame, slow: DataFrame, slow_ms: int, wild: float = WILD) -> DataFrame:
    """The benchmark's state per fast bar, from its direction in both intervals and its mean true range.

    ``fast`` and ``slow`` are features of the benchmark alone; a fast bar meets the last slow bar that
    had closed when it opened. Both up: bull; both down: bear; else range; volatile where the range is wild.
    """
    past = slow.select((F.col("open_time") + slow_ms).alias("_from"), F.col("direction").alias("_slow"))
    rows = fast.withColumn("_from", F.floor(F.col("open_time") / slow_ms) * slow_ms).join(past, "_from", "left")
    agreed = F.when((F.col("direction") == "LONG") & (F.col("_slow") == "LONG"), "bull").when((F.col("direction") == "SHORT") & (F.col("_slow") == "SHORT"), "bear").otherwise("range")
    state = F.when(F.col("atr") >= F.col("close") * wild, "volatile").otherwise(agreed)
    return rows.select("open_time", "direction", F.col("_slow").alias("slow_direction"), state.alias("state"))


def percentile(rows: DataFrame, value: str, days: int) -> DataFrame:
    """The share of a symbol's values of the last days that are at most the present one, in percent.

    Rows meet in blocks of ``days`` that repeat the block before, so a task holds the values of
    twice that time. Null values are not counted; without any value the share is null.
    """
    span = days * DAY
    held = blocked(rows, span, span, place="open_time")
    name = f"{value}_percentile"
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def shares(part: pa.Table) -> pa.Table:
        part = part.sort_by("open_time")
        at, x = part.column("open_time").to_numpy(), part.column(value).cast(pa.float64()).to_numpy()
        own = np.flatnonzero(part.column("own").to_numpy())
        low, high = np.searchsorted(at, at[own] - span, "left"), np.searchsorted(at, at[own], "right")
        there = np.concatenate([[0], np.cumsum(~np.isnan(x))])
        below = np.array([np.count_nonzero(x[a:b] <= x[i]) for i, a, b in zip(own, low, high, strict=True)], float)
        n = there[high] - there[low]
        out = np.floor(below / np.maximum(n, 1) * 100 * 1e4 + 0.5) / 1e4
        return part.take(pa.array(own)).drop_columns(["own", "block"]).append_column(name, pa.array(out, mask=n == 0))

    return held.groupBy("symbol", "block").applyInArrow(shares, schema)


def daily_cap(signals: DataFrame, most: int = 3, order: str = "created_ms") -> DataFrame:
    """At most ``most`` signals per symbol and day, the best first."""
    day = F.floor(F.col(order) / DAY)
    w = Window.partitionBy("symbol", day).orderBy(F.desc("score"), order)
    return signals.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
