"""What readers see: recent signals, one signal, the radar, and clean values from stored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import js

# What enumerations allow.
LIFECYCLES = ("detected", "watching", "setup_confirmed", "planned", "waiting_entry", "entered", "no_chase", "expired", "invalidated", "hit_tp1", "hit_tp2", "hit_tp3", "hit_sl", "archived")
SIGNAL_TYPES = ("trend_pullback", "volume_breakout", "risk_anomaly")
ENTRY_MODES = ("pullback_limit", "breakout_confirm", "confirmation_wait")
PENDING, WAITING, NOT_CONNECTED, NORMAL = "待确认", "等待确认", "未接入", "normal_vol"


def recent(signals: DataFrame, n: int = 20) -> DataFrame:
    """The n newest signals; a limit that is the feature."""
    return signals.orderBy(F.desc("created_ms"), "id").limit(n)


def by_id(signals: DataFrame, wanted: str | DataFrame) -> DataFrame:
    """The signal with an id, given as text or as a table of one row."""
    if isinstance(wanted, DataFrame):
        return signals.join(F.broadcast(wanted.select("id")), "id", "left_semi").limit(1)
    return signals.filter(F.col("id") == wanted).limit(1)


def latest_per_symbol(signals: DataFrame) -> DataFrame:
    rest = [c for c in signals.columns if c != "symbol"]
    return signals.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("created_ms", "id")).alias("r")).select("symbol", "r.*")


def radar(signals: DataFrame, newest: int = 50) -> DataFrame:
    """One row per symbol among the newest signals."""
    rows = latest_per_symbol(recent(signals, newest))
    return rows.select(
        "symbol",
        F.when(F.col("level").isin("S", "A"), "C").otherwise("B").alias("pool"),
        js.fixed_text(F.col("relative_strength"), 2).cast("double").alias("rs"),
        F.lit("-").alias("volume_ratio"),
        F.when(F.col("entry_low").isNotNull(), NORMAL).otherwise(PENDING).alias("atr_state"),
        F.lit(NOT_CONNECTED).alias("funding"),
        "score",
    )


def coerced(rows: DataFrame) -> DataFrame:
    """Stored text as clean values: numbers, enumerations, lists and maps with their defaults."""
    return rows.select(
        "id",
        js.number(F.col("score")).alias("score"),
        js.one_of(F.col("direction"), ("LONG", "SHORT"), "LONG").alias("direction"),
        js.one_of(F.col("signal_type"), SIGNAL_TYPES, "trend_pullback").alias("signal_type"),
        js.one_of(F.col("lifecycle_status"), LIFECYCLES, "detected").alias("lifecycle_status"),
        js.one_of(F.col("level"), ("S", "A", "B", "C"), "NONE").alias("level"),
        js.text_or(F.col("btc_state"), "range").alias("btc_state"),
        F.when(js.number_like(F.col("entry_low")), js.number(F.col("entry_low"))).alias("entry_low"),
        F.array_join(js.text_array(F.col("reasons")), "|").alias("reasons"),
        js.number(F.element_at(js.text_map(F.col("no_chase_rule")), "noChasePrice")).alias("no_chase_price"),
    )


# The words that decide a badge's colour, tried in this order.
BADGES = (("green", ("S", "正常", "planned")), ("blue", ("A", "trend")), ("yellow", ("B", "观察", "watching")), ("red", ("SHORT", "风险")))


def badge(value: Column) -> Column:
    out = None
    for colour, words in BADGES:
        hit = value.contains(words[0])
        for word in words[1:]:
            hit = hit | value.contains(word)
        out = F.when(hit, colour) if out is None else out.when(hit, colour)
    return out.otherwise("")


def with_fallback(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """The rows, or the samples where there is none; decided in the plan, by a count of at most one row."""
    some = rows.limit(1).agg(F.count("*").alias("_some"))
    shown = samples.select(*rows.columns).crossJoin(F.broadcast(some)).filter("_some = 0").drop("_some")
    return rows.unionByName(shown)


def displayed(signals: DataFrame) -> DataFrame:
    """Signals as texts for a page: entry zone, stop and second target, ratio; WAITING where there is no plan."""
    text = js.number_text
    joined = lambda a, between, b: F.coalesce(F.concat(text(F.col(a)), F.lit(between), text(F.col(b))), F.lit(WAITING))
    return signals.select(
        "id",
        "symbol",
        "level",
        "score",
        joined("entry_low", "-", "entry_high").alias("entry"),
        joined("stop_loss", "/", "tp2").alias("stop_and_target"),
        F.coalesce(F.concat(F.lit("1:"), js.fixed_text(F.col("weighted_rr"), 1)), F.lit(WAITING)).alias("ratio"),
    )


def slim(signals: DataFrame) -> DataFrame:
    """What a run answers with, per signal."""
    return signals.select("symbol", "level", "score", F.col("lifecycle_status").alias("status"))
