"""Rolling indicators of candles, all over one window specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.dialect import ATR_BARS, DIRECTION_BARS, STRENGTH_BARS, STRUCTURE_BARS, Dialect
from tidemark.functions.js import clamp, pct_change
from tidemark.operators.ordered import blocked, numbered, running

#: Earlier bars that the longest bounded frame needs.
HALO = 120


def series() -> WindowSpec:
    """The one window of all indicators: a block of a series in time order, bars of one time as they are numbered."""
    return Window.partitionBy("symbol", "block").orderBy("seq")


def true_range() -> Column:
    previous = F.lag("close").over(series())
    return F.when(previous.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)))


def atr(bars: int = ATR_BARS) -> Column:
    """Simple mean of the last true ranges; 0 for the first bar."""
    return F.coalesce(F.avg("true_range").over(series().rowsBetween(-(bars - 1), 0)), F.lit(0.0))


def volume_ratio(bars: int, default: float) -> Column:
    base = F.avg("quote_volume").over(series().rowsBetween(-bars, -1))
    return F.when(F.coalesce(base, F.lit(0.0)) == 0, F.lit(default)).otherwise(F.col("quote_volume") / base)


def structure_low(bars: int = STRUCTURE_BARS) -> Column:
    return F.min("low").over(series().rowsBetween(-(bars - 1), 0))


def structure_high(bars: int = STRUCTURE_BARS) -> Column:
    return F.max("high").over(series().rowsBetween(-(bars - 1), 0))


def move(bars: int = STRENGTH_BARS) -> Column:
    """Change in percent over the last bars; 0 for the first bar."""
    return pct_change(F.first("close").over(series().rowsBetween(-(bars - 1), 0)), F.col("close"))


def direction(bars: int = DIRECTION_BARS) -> Column:
    return F.when(F.col("close") >= F.lag("close", bars).over(series()), "LONG").otherwise("SHORT")


def quality(open_bars: Column, duplicates: Column, gaps: Column, stale: Column | None = None) -> Column:
    """100 less 20 per open bar, 25 for duplicates, 10 per gap and 25 for old data, within 0 and 100."""
    stale = F.lit(False) if stale is None else stale
    return clamp(F.lit(100.0) - open_bars * 20 - F.when(duplicates > 0, 25).otherwise(0) - gaps * 10 - F.when(stale, 25).otherwise(0), 0, 100)


def features(candles: DataFrame, dialect: Dialect, interval_ms: int, now: Column | None = None) -> DataFrame:
    """Candles with seq, bars and every indicator; ``quality`` over the dialect's frame.

    One exchange carries all bounded frames. Open bars are kept (see ``quality``). With ``now``
    (ms), a bar that ended more than two intervals before is stale.
    """
    return in_blocks(blocked(numbered(candles), HALO), dialect, interval_ms, now)


def in_blocks(df: DataFrame, dialect: Dialect, interval_ms: int, now: Column | None = None) -> DataFrame:
    """``features`` of bars that have seq, block and own: the own ones, of which each block holds the HALO bars before."""
    stale = None if now is None else now - F.col("close_time") > 2 * interval_ms
    df = df.withColumn("true_range", true_range())
    step = F.col("open_time") - F.lag("open_time").over(series())
    df = df.withColumns({"_gap": F.when(step > 1.5 * interval_ms, 1).otherwise(0), "_open": F.when(F.col("is_closed"), 0).otherwise(1), "_dup": F.when(step == 0, 1).otherwise(0)})
    columns = {
        "atr": atr(),
        "volume_ratio": volume_ratio(dialect.volume_bars, dialect.volume_default),
        "structure_low": structure_low(),
        "structure_high": structure_high(),
        "move": move(),
        "direction": direction(),
    }
    if dialect.quality_bars:
        n = dialect.quality_bars
        frame, pairs = series().rowsBetween(-(n - 1), 0), series().rowsBetween(-(n - 2), 0)
        columns["quality"] = quality(F.sum("_open").over(frame), F.sum("_dup").over(pairs), F.sum("_gap").over(pairs), stale)
    out = df.withColumns(columns).filter("own").drop("own")
    if not dialect.quality_bars:
        totals = {name: ("sum", F.col(name)) for name in ("_gap", "_open", "_dup")}
        out = running(out, ["symbol"], ["seq"], ["block"], {f"{k}s": v for k, v in totals.items()})
        out = out.withColumn("quality", quality(F.col("_opens"), F.col("_dups"), F.col("_gaps"), stale)).drop("_gaps", "_opens", "_dups")
    return out.drop("_gap", "_open", "_dup", "block")


def with_benchmark(rows: DataFrame, benchmark: str) -> DataFrame:
    """Bars joined with the benchmark's bar of the same open time, as relative strength; bars without one are dropped."""
    base = rows.filter(F.col("symbol") == benchmark).select("open_time", F.col("move").alias("benchmark_move"), F.col("seq").alias("benchmark_seq"))
    # both sides are partitioned by time, so the size of the benchmark's series doesn't matter
    return rows.join(base, "open_time").withColumn("relative_strength", F.col("move") - F.col("benchmark_move"))
