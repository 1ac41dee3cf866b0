"""Summaries of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dialect import DEFAULT_SYMBOLS
from tidemark.functions.js import iso_time, js_round

# What a trade may end as, in alphabetical order.
FINAL_STATUSES = ("expired", "hit_sl", "hit_tp1", "hit_tp2", "hit_tp3")
#: The order in which trades were appended: by step, then symbol as configured, then time; a series in pieces one after another.
PIECE, WITHIN = ["step", "symbol_place", "symbol", "piece"], ["seq"]


def symbol_place(symbols: tuple[str, ...]) -> Column:
    """A symbol's place in the configured list; those that aren't in it come last."""
    listed = F.array(*map(F.lit, symbols)) if symbols else F.array().cast("array<string>")
    at = F.array_position(listed, F.col("symbol")).cast("int")
    return F.when(at > 0, at).otherwise(len(symbols) + 1)


def pieces(trades: DataFrame, symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    return trades.withColumns({"piece": F.floor(F.col("seq") / 4096), "symbol_place": symbol_place(symbols)})


def path_measures(trades: DataFrame, keys: list[str], scale: float | None = 1e4, symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    """max_drawdown and max_losing_streak per ``keys``, in the order in which trades were appended.

    Each piece of a series is measured on its own (its total, highest and lowest sum so far, fall
    from a peak, runs of losses at its ends and inside); the few pieces of a key are then joined in
    order. The peak starts at 0; a trade that isn't a loss ends a run.
    """
    w = Window.partitionBy(*keys, *PIECE).orderBy(*WITHIN).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col("final_r") < 0
    rows = pieces(trades, symbols).withColumns({"_sum": F.sum("final_r").over(w), "_run": F.sum(F.when(lost, 0).otherwise(1)).over(w)})
    island = Window.partitionBy(*keys, *PIECE, "_run").orderBy(*WITHIN).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_peak": F.max("_sum").over(w), "_losses": F.sum(F.when(lost, 1).otherwise(0)).over(island)})
    parts = rows.groupBy(*dict.fromkeys([*keys, *PIECE])).agg(
        F.sum("final_r").alias("total"),
        F.max("_sum").alias("high"),
        F.min("_sum").alias("low"),
        F.max(F.col("_peak") - F.col("_sum")).alias("fall"),
        F.max(F.when(F.col("_run") == 0, F.col("_losses")).otherwise(0)).alias("head"),
        F.max("_losses").alias("best"),
        F.max_by(F.when(lost, F.col("_losses")).otherwise(0), "seq").alias("tail"),
        (F.max("_run") == 0).alias("all_lost"),
        F.count("*").alias("n"),
    )
    order = F.struct(*PIECE, "total", "high", "low", "fall", "head", "best", "tail", "all_lost", "n")
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    start = F.struct(zero.alias("equity"), zero.alias("peak"), zero.alias("drawdown"), none.alias("streak"), none.alias("longest"))

    def then(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["equity"] + p["total"]).alias("equity"),
            F.greatest(acc["peak"], acc["equity"] + p["high"]).alias("peak"),
            F.greatest(acc["drawdown"], p["fall"], acc["peak"] - acc["equity"] - p["low"]).alias("drawdown"),
            F.when(p["all_lost"], acc["streak"] + p["n"]).otherwise(p["tail"]).alias("streak"),
            F.greatest(acc["longest"], p["best"], acc["streak"] + p["head"]).alias("longest"),
        )

    joined = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_p")).withColumn("_m", F.aggregate("_p", start, then))
    drawdown = js_round(F.col("_m.drawdown"), scale) if scale else F.col("_m.drawdown")
    return joined.select(*keys, drawdown.alias("max_drawdown"), F.col("_m.longest").alias("max_losing_streak"))


def max_drawdown(trades: DataFrame, keys: list[str], symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    return path_measures(trades, keys, symbols=symbols).select(*keys, "max_drawdown")


def losing_streak(trades: DataFrame, keys: list[str], symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    return path_measures(trades, keys, symbols=symbols).select(*keys, "max_losing_streak")


def basic(scale: float | None) -> dict[str, Column]:
    """The aggregates that don't depend on the order."""
    rounded = (lambda c: js_round(c, scale)) if scale else (lambda c: c)
    r, n = F.col("final_r"), F.count("*")
    gains, losses = F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    # results have four decimals; a sum cleared of what adding left behind makes ties round alike in any order
    mean = lambda c: js_round(F.sum(c), 1e6) / n
    part = lambda c: rounded(F.when(n == 0, 0.0).otherwise(F.count_if(c) / n * 100))
    return {
        "trades": n,
        "win_rate": part(r > 0),
        "entry_fill_rate": part(F.col("entry_hit")),
        "avg_r": rounded(F.coalesce(mean(r), F.lit(0.0))),
        "total_r": rounded(F.coalesce(F.sum(r), F.lit(0.0))),
        "median_r": rounded(F.median(r)),
        "profit_factor": rounded(F.when(losses == 0, gains).otherwise(gains / losses)),
        "avg_mfe": rounded(mean(F.col("mfe"))),
        "avg_mae": rounded(mean(F.col("mae"))),
        "avg_score": rounded(mean(F.col("score"))),
    }


def status_counts() -> Column:
    """``status:count`` of each final status that occurs, comma-joined."""
    n = lambda s: F.count_if(F.col("final_status") == s)
    return F.concat_ws(",", *(F.when(n(s) > 0, F.concat(F.lit(f"{s}:"), n(s).cast("string"))) for s in FINAL_STATUSES))


def summary(trades: DataFrame, keys: list[str], scale: float | None = 1e4, symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    """One row per ``keys``: counts, rates, results, drawdown, streak, statuses, and the rank by total result.

    The trades are read twice, in any order and in that in which they were appended; what makes
    them is one exchange, which the plan uses for both.
    """
    base = trades.groupBy(*keys).agg(*(c.alias(k) for k, c in basic(scale).items()), status_counts().alias("status_counts"))
    out = base.join(path_measures(trades, keys, scale, symbols), keys)
    # a row per group: few, so one task may rank them
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_r"), *keys)))


def summary_sets(trades: DataFrame, sets: dict[str, tuple[list[str], Column]], scale: float | None = 1e4, symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    """Several summaries in one pass: grouping (the name in ``sets``), the columns that any of them groups by (null where it doesn't), and the columns of ``summary``.

    A trade is repeated for each set whose condition it meets. Sets are told apart by name and groups by
    the text of their keys, so nulls don't clash; a rank counts the groups of one set. Order-free and
    ordered measures both start from the repeated rows, so let ``trades`` be a stored table.
    """
    every = list(dict.fromkeys(k for keys, _ in sets.values() for k in keys))
    ids = {name: F.struct(F.lit(name).alias("grouping"), *((F.col(k) if k in keys else F.lit(None).cast(trades.schema[k].dataType)).alias(f"by_{k}") for k in every)) for name, (keys, _) in sets.items()}
    rows = trades.withColumn("_set", F.explode(F.array_compact(F.array(*(F.when(only, ids[name]) for name, (_, only) in sets.items())))))
    rows = rows.withColumns({"grouping": F.col("_set.grouping"), "_group": F.to_json("_set")})
    keys = ["grouping", "_group"]
    own = F.first("_set").alias("_set")
    base = rows.groupBy(*keys).agg(own, *(c.alias(k) for k, c in basic(scale).items()), status_counts().alias("status_counts"))
    out = base.join(path_measures(rows, keys, scale, symbols), keys)
    order = Window.partitionBy("grouping").orderBy(F.desc("total_r"), *(F.col(f"_set.by_{k}") for k in every))
    out = out.withColumn("rank", F.row_number().over(order))
    return out.select("grouping", *(F.col(f"_set.by_{k}").alias(k) for k in every), *(c for c in out.columns if c not in ("grouping", "_group", "_set")))


def status_histogram(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys, "final_status").agg(F.count("*").alias("n"))


def library_summary(trades: DataFrame, keys: list[str], symbols: tuple[str, ...] = DEFAULT_SYMBOLS) -> DataFrame:
    """The nine measures of a backtest run, none rounded: two of them are constants, as every trade of a run is executed and none is chased."""
    base = trades.groupBy(*keys).agg(*(basic(None)[k].alias(k) for k in ("trades", "win_rate", "avg_r", "profit_factor", "entry_fill_rate")))
    out = base.join(path_measures(trades, keys, None, symbols), keys) if keys else base.crossJoin(path_measures(trades, keys, None, symbols))
    constants = {"no_chase_rate": F.lit(0.0), "execution_rate": F.when(F.col("total_trades") > 0, 100.0).otherwise(0.0)}
    return out.withColumnRenamed("trades", "total_trades").withColumns(constants)


def execution_rates(evaluations: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: the share of evaluations whose price has run away, and of planned ones whose entry was reached, in percent."""
    chased = evaluations.groupBy(*keys).agg(js_round(F.count_if("no_chase") / F.count("*") * 100, 1e4).alias("no_chase_rate"))
    entered = outcomes.groupBy(*keys).agg(js_round(F.count_if("entry_hit") / F.count("*") * 100, 1e4).alias("execution_rate"))
    return chased.join(entered, keys, "left").select(*keys, "no_chase_rate", F.coalesce("execution_rate", F.lit(0.0)).alias("execution_rate"))


def coverage(candles: DataFrame) -> DataFrame:
    out = candles.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    return out.select("symbol", "bars", iso_time(F.col("a")).alias("first_open"), iso_time(F.col("b")).alias("last_open"))
