"""Reports of a run as JSON: the backtest's report, its row in the store, and the answer of a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import DEFAULT_SYMBOLS
from tidemark.functions.js import iso_time, number_text
from tidemark.operators.metrics import FINAL_STATUSES, symbol_place

#: Trades that a report shows; a limit that is the feature.
SAMPLE_TRADES = 20


def number(x: Column) -> Column:
    """A number as JSON, without trailing zeros."""
    return F.coalesce(number_text(x.cast("double")), F.lit("null"))


def text(x: Column) -> Column:
    """A text as JSON."""
    escaped = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def members(fields: dict[str, Column]) -> Column:
    """A JSON object of named values, each JSON already."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _listed(rows: DataFrame, order: list[Column], value: Column, name: str, brackets: str) -> DataFrame:
    """One row: the values of a few rows in order, as a JSON array or object."""
    out = rows.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), value.alias("v")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select(F.concat(F.lit(brackets[0]), F.array_join(F.transform("xs", lambda x: x["v"]), ","), F.lit(brackets[1])).alias(name))


MEASURES = {
    "trades": "trades", "winRate": "win_rate", "entryFillRate": "entry_fill_rate", "avgR": "avg_r", "medianR": "median_r", "totalR": "total_r", "profitFactor": "profit_factor",
    "maxDrawdownR": "max_drawdown", "maxLosingStreak": "max_losing_streak", "avgMfe": "avg_mfe", "avgMae": "avg_mae", "avgScore": "avg_score",
}


def summaries(summary: DataFrame, keys: list[str], name: str, suffix: str = "") -> DataFrame:
    """One row: a summary as a JSON object, its groups by total result."""
    key = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    counts = lambda s: F.regexp_extract("status_counts", f"{s}:([0-9]+)", 1)
    statuses = F.concat(F.lit("{"), F.concat_ws(",", *(F.when(counts(s) != "", F.concat(F.lit(f'"{s}":'), counts(s))) for s in FINAL_STATUSES)), F.lit("}"))
    body = members({k: number(F.col(c)) for k, c in MEASURES.items()} | {"statusCounts": statuses})
    return _listed(summary, [F.col("rank")], F.concat(text(F.concat(key, F.lit(suffix))), F.lit(":"), body), name, "{}")


def coverage(covered: DataFrame, symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    """One row: bars and the first and last time of each symbol, in configured order."""
    body = members({"candles": number(F.col("bars")), "first": text(F.col("first_open")), "last": text(F.col("last_open"))})
    return _listed(covered, [symbol_place(symbols), F.col("symbol")], F.concat(text(F.col("symbol")), F.lit(":"), body), "data_coverage", "{}")


def first_trades(trades: DataFrame, symbols: tuple[str, ...] = DEFAULT_SYMBOLS, most: int = SAMPLE_TRADES) -> DataFrame:
    """The first trades of the finest polling, in the order in which they were appended, with their time as ISO text."""
    rows = trades.filter("step = 1").withColumn("_place", symbol_place(symbols)).orderBy("_place", "symbol", "seq").limit(most)
    return rows.select("_place", "seq", iso_time(F.col("open_time")).alias("time"), "symbol", "direction", "level", "score", "final_status", "final_r")


def samples(trades: DataFrame) -> DataFrame:
    body = members({"time": text(F.col("time")), "symbol": text(F.col("symbol")), "direction": text(F.col("direction")), "level": text(F.col("level")), "score": number(F.col("score")), "finalStatus": text(F.col("final_status")), "finalR": number(F.col("final_r"))})
    return _listed(trades, [F.col("_place"), F.col("symbol"), F.col("seq")], body, "sample_trades", "[]")


def report(sections: list[DataFrame], assumptions: dict[str, Column]) -> DataFrame:
    """One row: ``report``, the JSON of all sections (one row each) under their names."""
    out = reduce(lambda a, b: a.crossJoin(b), sections)
    return out.select(members({"assumptions": members(assumptions)} | {c: F.col(c) for s in sections for c in s.columns}).alias("report"))


def backtest_run(summary: DataFrame, symbols: DataFrame, fee: float, slippage: float) -> DataFrame:
    """One row of the store: the symbols that were run, the cost model and the nine measures, as JSON."""
    names = {"totalTrades": "total_trades", "winRate": "win_rate", "avgR": "avg_r", "profitFactor": "profit_factor", "maxDrawdown": "max_drawdown", "maxLosingStreak": "max_losing_streak", "entryFillRate": "entry_fill_rate", "noChaseRate": "no_chase_rate", "executionRate": "execution_rate"}
    result = members({k: number(F.col(c)) for k, c in names.items()})
    cost = members({"feeRate": number(F.lit(fee)), "slippageRate": number(F.lit(slippage))})
    run = _listed(symbols.select("symbol").distinct(), [F.col("symbol")], text(F.col("symbol")), "symbols", "[]")
    return run.crossJoin(summary.select(cost.alias("cost_model"), result.alias("result_summary")))


def answer(counters: DataFrame, slim: DataFrame) -> DataFrame:
    """One row: what a scan answers with, its counters and its signals by symbol, as JSON."""
    counts = members({"ok": F.lit("true")} | {c: number(F.col(c)) for c in counters.columns})
    signal = members({"symbol": text(F.col("symbol")), "level": text(F.col("level")), "score": number(F.col("score")), "status": text(F.col("status"))})
    rows = _listed(slim, [F.col("symbol")], signal, "signals", "[]")
    return counters.select(counts.alias("counters")).crossJoin(rows).select("counters", "signals")
