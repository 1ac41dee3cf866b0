"""What became of each plan: the first touch of its levels within the next bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import Dialect
from tidemark.functions.js import js_round


def with_costs(r: Column, fee: Column | float, slippage: Column | float) -> Column:
    cost = (F.lit(fee) if isinstance(fee, float) else fee) + (F.lit(slippage) if isinstance(slippage, float) else slippage)
    return js_round(r - F.signum(r) * cost * 2, 1e4)


def simulated(candidates: DataFrame, bars: DataFrame, horizon: int, dialect: Dialect) -> DataFrame:
    """Candidates (symbol, seq, direction, plan fields) with final_status, entry_hit, final_r, mfe, mae and duration.

    A candidate meets the ``horizon`` bars after it by an equi-join on buckets of that many bars, so
    each meets two buckets. The few bars of a candidate are then folded in order: entry at the first
    bar that overlaps the entry zone; from there stop, third, second and first target are tested.
    """
    size = F.lit(horizon)
    left = candidates.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("seq") + 1) / size), F.floor((F.col("seq") + size) / size))))
    right = bars.select("symbol", F.floor(F.col("seq") / size).alias("_bucket"), F.struct(F.col("seq").alias("at"), "high", "low").alias("_bar"))
    met = left.join(right, ["symbol", "_bucket"]).filter((F.col("_bar.at") > F.col("seq")) & (F.col("_bar.at") <= F.col("seq") + size))
    key = [c for c in candidates.columns]
    gathered = met.groupBy("symbol", "seq", "direction").agg(*(F.first(c).alias(c) for c in key if c not in ("symbol", "seq", "direction")), F.array_sort(F.collect_list("_bar")).alias("_bars"))
    return folded(gathered, key, dialect)


def folded(gathered: DataFrame, key: list[str], dialect: Dialect) -> DataFrame:
    """The columns ``key`` of candidates and their outcomes, from ``_bars``, the bars (at, high, low) after each in order."""
    long = F.col("direction") == "LONG"
    unit = F.abs(F.col("entry_high") - F.col("stop_loss"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("hit"), F.lit(0.0).alias("mfe"), F.lit(0.0).alias("mae"), none.alias("status"), F.lit(None).cast("bigint").alias("at"))

    def step(acc: Column, bar: Column) -> Column:
        high, low = bar["high"], bar["low"]
        hit = acc["hit"] | ((low <= F.col("entry_high")) & (high >= F.col("entry_low")))
        good = F.when(long, high - F.col("entry_high")).otherwise(F.col("entry_low") - low) / unit
        bad = F.when(long, F.col("entry_high") - low).otherwise(high - F.col("entry_low")) / unit
        beyond = lambda level: F.when(long, high >= F.col(level)).otherwise(low <= F.col(level))
        status = F.when(F.when(long, low <= F.col("stop_loss")).otherwise(high >= F.col("stop_loss")), "hit_sl").when(beyond("tp3"), "hit_tp3").when(beyond("tp2"), "hit_tp2").when(beyond("tp1"), "hit_tp1")
        live = hit & acc["status"].isNull()
        return F.struct(
            hit.alias("hit"),
            F.when(live, F.greatest(acc["mfe"], good)).otherwise(acc["mfe"]).alias("mfe"),
            F.when(live, F.greatest(acc["mae"], bad)).otherwise(acc["mae"]).alias("mae"),
            F.when(live, status).otherwise(acc["status"]).alias("status"),
            F.when(live & status.isNotNull(), bar["at"]).otherwise(acc["at"]).alias("at"),
        )

    out = gathered.withColumn("_o", F.aggregate("_bars", start, step))
    r = F.when(F.col("_o.status") == "hit_sl", -1.0).when(F.col("_o.status") == "hit_tp1", 1.0).when(F.col("_o.status") == "hit_tp2", 2.0).when(F.col("_o.status") == "hit_tp3", 3.0).otherwise(0.0)
    return out.select(
        *key,
        F.col("_o.hit").alias("entry_hit"),
        F.coalesce("_o.status", F.lit("expired")).alias("final_status"),
        with_costs(r, dialect.fee, dialect.slippage).alias("final_r"),
        js_round(F.col("_o.mfe"), 1e4).alias("mfe"),
        js_round(F.col("_o.mae"), 1e4).alias("mae"),
        F.coalesce(F.col("_o.at") - F.col("seq"), F.size("_bars")).cast("bigint").alias("duration"),
    )
