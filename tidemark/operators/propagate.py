"""Corrected and late bars: only what they can change is evaluated anew.

A bar enters the indicators of the HALO bars after it and the outcomes of the signals up to one
horizon before it; a bar of the benchmark enters the relative strength of all symbols at the times
of its own HALO bars after it. These rows are touched. Their blocks, and the benchmark's blocks at
their times, are evaluated from the corrected bars; what differs from the stored results is
retracted and what is new is emitted. Rows that no correction touches are neither read nor computed.

Results are kept by symbol and open time: a late bar moves the numbers of the bars after it,
but not what is said of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import Dialect
from tidemark.operators import indicators, outcome, plan
from tidemark.operators.ordered import blocked, numbered
from tidemark.operators.state import upserted
from tidemark.plans.historical import CARRIED, candidates
from tidemark.shared import written

#: Bars of a block that is evaluated as a whole.
SIZE = 512
KEY = ["symbol", "open_time"]
RESULT = [*KEY, "direction", "level", "score", "entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "entry_hit", "final_status", "final_r", "mfe", "mae", "duration"]


def corrected(bars: DataFrame, corrections: DataFrame) -> DataFrame:
    """``bars`` with those of ``corrections`` in place of the ones of the same symbol and open time, or added to them; both have one row per key."""
    old, new = bars.withColumn("_turn", F.lit(0)), corrections.select(*bars.columns).withColumn("_turn", F.lit(1))
    return upserted(old, new, KEY, "_turn").select(*bars.columns)


def touched(numbered_bars: DataFrame, corrections: DataFrame, horizon: int, benchmark: str, halo: int = indicators.HALO) -> DataFrame:
    """symbol, open_time and seq of the bars whose evaluation or outcome may change; ``numbered_bars`` hold the corrections."""
    places = numbered_bars.select("symbol", "open_time", "seq")
    hit = places.join(corrections.select(*KEY).distinct(), KEY, "left_semi")
    near = hit.select("symbol", F.explode(F.sequence(F.col("seq") - horizon, F.col("seq") + halo)).alias("seq")).distinct()
    own = places.join(near, ["symbol", "seq"], "left_semi")
    # the benchmark: all symbols at the times of its bars from the correction on
    behind = hit.filter(F.col("symbol") == benchmark).select("symbol", F.explode(F.sequence(F.col("seq"), F.col("seq") + halo)).alias("seq")).distinct()
    times = places.join(behind, ["symbol", "seq"], "left_semi").select("open_time")
    return own.unionByName(places.join(times, "open_time", "left_semi").select("symbol", "open_time", "seq")).distinct()


def evaluated(numbered_bars: DataFrame, rows: DataFrame, dialect: Dialect, benchmark: str, size: int = SIZE) -> DataFrame:
    """The evaluations of ``rows`` (symbol, open_time, seq), from their blocks of ``numbered_bars`` alone.

    Only for dialects whose quality has a bounded frame: an unbounded one lets a bar change all after it.
    """
    if not dialect.quality_bars or dialect.quality_bars > indicators.HALO:
        raise ValueError("quality needs a frame that the halo holds")
    base = numbered_bars.filter(F.col("symbol") == benchmark).join(rows.select("open_time").distinct(), "open_time", "left_semi")
    needed = rows.select("symbol", "seq").unionByName(base.select("symbol", "seq")).distinct()
    blocks = needed.select("symbol", F.floor(F.col("seq") / size).alias("block")).distinct()
    held = blocked(numbered_bars, indicators.HALO, size).join(blocks, ["symbol", "block"], "left_semi")
    features = indicators.in_blocks(held, dialect, dialect.interval_ms).join(needed, ["symbol", "seq"], "left_semi")
    out = indicators.with_benchmark(features, benchmark).join(rows.select("symbol", "seq"), ["symbol", "seq"], "left_semi")
    out = out.filter((F.col("symbol") != benchmark) & (F.col("seq") >= dialect.least_seq) & (F.col("benchmark_seq") >= dialect.least_seq))
    return plan.evaluated(out, dialect)


def results(numbered_bars: DataFrame, rows: DataFrame, dialect: Dialect, benchmark: str) -> DataFrame:
    """The outcomes of the planned signals among ``rows``, by RESULT."""
    chosen = candidates(evaluated(numbered_bars, rows, dialect, benchmark), dialect).select(*CARRIED)
    return outcome.simulated(chosen, numbered_bars.select("symbol", "seq", "high", "low"), dialect.horizon, dialect).select(*RESULT)


def whole(bars: DataFrame, dialect: Dialect, benchmark: str) -> DataFrame:
    """The results of all bars, as a first run stores them."""
    rows = numbered(bars)
    return results(rows, rows.select("symbol", "open_time", "seq"), dialect, benchmark)


def changes(stored: DataFrame, bars: DataFrame, corrections: DataFrame, dialect: Dialect, benchmark: str) -> tuple[DataFrame, DataFrame]:
    """The touched bars, and the rows of RESULT that are retracted (op ``-``) or emitted (op ``+``).

    ``bars`` are the corrected ones. A result that comes out as it was is in neither. Without corrections there are no changes.
    """
    rows = written(numbered(bars), "numbered")
    near = written(touched(rows, corrections, dialect.horizon, benchmark), "touched")
    old = stored.select(*RESULT).join(near, KEY, "left_semi").withColumn("op", F.lit("-"))
    new = results(rows, near, dialect, benchmark).withColumn("op", F.lit("+"))
    # a row on both sides is no change; all columns of a result decide
    both = old.unionByName(new).groupBy(*RESULT).agg(F.min("op").alias("op"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return near, both


def applied(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """``stored`` without what was retracted and with what was emitted."""
    gone = changed.filter("op = '-'").select(*KEY)
    return stored.select(*RESULT).join(gone, KEY, "left_anti").unionByName(changed.filter("op = '+'").select(*RESULT))
