"""Ticks to signals with state per key: a ring of the last bars per symbol, the last logged state per opportunity.

Ticks become bars in steps. Each batch's ticks are summed up to one row per symbol and bar inside the
tasks that read them, so a symbol with a third of all ticks brings few rows to its state. The state of
a symbol holds its open bars and a ring of the last closed ones. A timer closes a bar when the watermark
has reached its end; the bars that close come out with the ring before them, which is all that the
indicators need. So a batch evaluates the bars that it closes and reads no earlier batch, and the state
doesn't grow with the stream.

All symbols' bars of one time close in one batch, so the benchmark's bar is there as well. Signals are
written per batch; a second stream keeps the last logged state of each opportunity and passes on what
differs from it. A batch that runs again writes the same files, and the second stream skips
signals up to the last one that it has seen of an opportunity, so each is logged once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.dialect import Dialect
from tidemark.functions.js import js_round, millis
from tidemark.operators import indicators, plan

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A bar while ticks come in: its first and last tick by (time to the nearest millisecond, tie), highest and lowest price, sum and number.
PARTIAL = "symbol string, open_time long, closes timestamp, first_ms long, first_tie long, open double, last_ms long, last_tie long, close double, high double, low double, total double, n long"
BAR = np.dtype([("open_time", "i8"), ("first_ms", "i8"), ("first_tie", "i8"), ("open", "f8"), ("last_ms", "i8"), ("last_tie", "i8"), ("close", "f8"), ("high", "f8"), ("low", "f8"), ("total", "f8"), ("n", "i8")])
OUT = "symbol string, seq long, own boolean, open_time long, open double, high double, low double, close double, total double, n long"


#: Rows of bars that a task holds before it joins those of one bar.
HELD = 100_000


def joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Parts of bars, in the columns of PARTIAL, as one row per symbol and bar."""
    rows, keys = pd.concat(parts, ignore_index=True), ["symbol", "open_time"]
    first = rows.sort_values(["first_ms", "first_tie"], kind="stable").drop_duplicates(keys)[[*keys, "closes", "first_ms", "first_tie", "open"]]
    last = rows.sort_values(["last_ms", "last_tie"], kind="stable").drop_duplicates(keys, keep="last")[[*keys, "last_ms", "last_tie", "close"]]
    whole = rows.groupby(keys, sort=False).agg(high=("high", "max"), low=("low", "min"), total=("total", "sum"), n=("n", "sum")).reset_index()
    return first.merge(last, on=keys).merge(whole, on=keys)


def partial_bars(ticks: DataFrame, interval_ms: int) -> DataFrame:
    """Ticks (symbol, ts, tie, price) as one row per symbol and bar of each task that reads them, or few; ticks without a symbol, time or price are dropped."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for t in batches:
            t = t.sort_values(["ms", "tie"], kind="stable")
            t["open_time"] = t["ms"] // interval_ms * interval_ms
            g = t.groupby(["symbol", "open_time"], sort=False)
            out = g.agg(first_ms=("ms", "first"), first_tie=("tie", "first"), open=("price", "first"), last_ms=("ms", "last"), last_tie=("tie", "last"), close=("price", "last"), high=("price", "max"), low=("price", "min"), total=("price", "sum"), n=("price", "size")).reset_index()
            out.insert(2, "closes", pd.to_datetime(out["open_time"] + interval_ms, unit="ms"))
            held.append(out)
            size += len(out)
            if size > HELD:
                held = [joined(held)]
                size = len(held[0])
                if size > HELD // 2:
                    yield held.pop()
                    size = 0
        if held:
            yield joined(held)

    own = ticks.select("symbol", millis(F.col("ts")).alias("ms"), F.col("tie").cast("long").alias("tie"), F.col("price").cast("double").alias("price"))
    return own.filter("symbol is not null and ms is not null and price is not null").mapInPandas(summed, PARTIAL)


def merged(bar: np.void | None, new: np.void) -> np.void:
    """Two parts of one bar as one."""
    if bar is None:
        return new
    out = bar.copy()
    if (new["first_ms"], new["first_tie"]) < (bar["first_ms"], bar["first_tie"]):
        for c in ("first_ms", "first_tie", "open"):
            out[c] = new[c]
    if (new["last_ms"], new["last_tie"]) > (bar["last_ms"], bar["last_tie"]):
        for c in ("last_ms", "last_tie", "close"):
            out[c] = new[c]
    out["high"], out["low"] = max(bar["high"], new["high"]), min(bar["low"], new["low"])
    out["total"], out["n"] = bar["total"] + new["total"], bar["n"] + new["n"]
    return out


class Bars(StatefulProcessor):
    """Open bars and the ring of closed ones of a symbol; a timer at the end of the first open bar closes all that have ended."""

    def __init__(self, interval_ms: int, ring: int):
        self.interval, self.ring = interval_ms, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bars", "open binary, ring binary, closed long")

    def _read(self) -> tuple[dict, np.ndarray, int]:
        kept = self.state.get() if self.state.exists() else None
        if kept is None:
            return {}, np.empty(0, BAR), 0
        return {int(b["open_time"]): b for b in np.frombuffer(bytes(kept[0]), BAR)}, np.frombuffer(bytes(kept[1]), BAR), int(kept[2])

    def _write(self, bars: dict, ring: np.ndarray, closed: int) -> None:
        own = np.array([bars[t] for t in sorted(bars)], BAR) if bars else np.empty(0, BAR)
        self.state.update((own.tobytes(), ring.tobytes(), closed))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars, ring, closed = self._read()
        earliest = min(bars, default=None)
        for part in rows:
            for new in part[list(BAR.names)].to_records(index=False).astype(BAR):
                at = int(new["open_time"])
                bars[at] = merged(bars.get(at), new)
        first = min(bars, default=None)
        if first is not None and first != earliest:
            self.handle.registerTimer(first + self.interval)
        self._write(bars, ring, closed)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bars, ring, closed = self._read()
        until = timerValues.getCurrentWatermarkInMs()
        ended = [t for t in sorted(bars) if t + self.interval <= until]
        if not ended:
            return
        new = np.array([bars.pop(t) for t in ended], BAR)
        rows = np.concatenate([ring, new])
        out = pd.DataFrame({"symbol": key[0], "seq": np.arange(closed - len(ring), closed + len(new)), "own": np.arange(len(rows)) >= len(ring)})
        for c in ("open_time", "open", "high", "low", "close", "total", "n"):
            out[c] = rows[c]
        if bars:
            self.handle.registerTimer(min(bars) + self.interval)
        self._write(bars, rows[-self.ring :], closed + len(new))
        yield out


class Changes(StatefulProcessor):
    """The last logged level and status of an opportunity, and the time of the last signal seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "level string, lifecycle_status string, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, status, seen = self.state.get() if self.state.exists() else (None, None, None)
        new = pd.concat(list(rows)).sort_values(["created_ms", "level", "lifecycle_status"], kind="stable")
        kept = []
        for i, r in enumerate(new.itertuples(index=False)):
            if seen is not None and r.created_ms <= seen:
                continue
            if (r.level, r.lifecycle_status) != (level, status):
                kept.append(i)
            level, status, seen = r.level, r.lifecycle_status, int(r.created_ms)
        self.state.update((level, status, seen))
        yield new.iloc[kept]


def closed_bars(ticks: DataFrame, interval_ms: int, late: str, ring: int = indicators.HALO) -> DataFrame:
    """A stream of the bars that close, ``own``, each time with the ``ring`` bars of their symbol before them.

    A bar closes when one that ends ``late`` after it has been seen. Ticks for a closed bar are dropped.
    """
    parts = partial_bars(ticks, interval_ms).withWatermark("closes", late)
    return parts.groupBy("symbol").transformWithStateInPandas(Bars(interval_ms, ring), OUT, "append", "eventTime")


def evaluated(closed: DataFrame, dialect: Dialect, benchmark: str) -> DataFrame:
    """The evaluations of a batch of ``closed_bars``."""
    rows = closed.withColumns({
        "close_time": F.col("open_time") + dialect.interval_ms - 1,
        "volume": F.col("n").cast("double"),
        "quote_volume": js_round(F.col("total"), 1e6),
        "trades": F.col("n").cast("int"),
        "is_closed": F.lit(True),
        "block": F.lit(0),
    }).drop("total", "n")
    rows = indicators.with_benchmark(indicators.in_blocks(rows, dialect, dialect.interval_ms), benchmark)
    rows = rows.filter((F.col("symbol") != benchmark) & (F.col("seq") >= dialect.least_seq) & (F.col("benchmark_seq") >= dialect.least_seq))
    return plan.evaluated(rows, dialect)


SIGNAL = "opportunity_id string, created_ms long, level string, lifecycle_status string"


def _with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a stream whose state lies in RocksDB, which state with timers needs; the session's setting stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        return start()
    finally:
        spark.conf.set(name, before)


def signals_to(ticks: DataFrame, path: str, dialect: Dialect, benchmark: str, signals: Callable[[DataFrame], DataFrame], late: str, every: str | None = "15 minutes") -> StreamingQuery:
    """The running stream from ticks to ``path/signals``, a folder per batch; ``every`` None takes what there is and ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        names = [f.name for f in T._parse_datatype_string(SIGNAL)]
        signals(evaluated(batch, dialect, benchmark)).select(*names).write.mode("overwrite").parquet(f"{path}/signals/batch={batch_id}")

    rows = closed_bars(ticks, dialect.interval_ms, late)
    out = rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint-signals")
    return _with_state(ticks.sparkSession, (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start)


def changes_to(spark: SparkSession, path: str, every: str | None = "15 minutes") -> StreamingQuery:
    """The running stream from ``path/signals`` to ``path/log``, the signals whose state differs from the one logged before."""
    rows = spark.readStream.schema(SIGNAL).option("recursiveFileLookup", "true").parquet(f"{path}/signals")
    changed = rows.groupBy("opportunity_id").transformWithStateInPandas(Changes(), SIGNAL, "append", "none")
    out = changed.writeStream.outputMode("append").format("parquet").option("path", f"{path}/log").option("checkpointLocation", f"{path}/checkpoint-log")
    return _with_state(spark, (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start)
