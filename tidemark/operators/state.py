"""Stored state: upserts, change detection, notifications, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import MAJORS
from tidemark.functions.js import iso_time
from tidemark.operators.ordered import before


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, one per key: the one with the highest ``order``."""
    rows = old.unionByName(new)
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.col(order)).alias("row")).select(*keys, "row.*")


def candle_quality(candles: DataFrame) -> DataFrame:
    """Candles as they are stored: 100 for a closed bar, 70 for an open one."""
    return candles.withColumn("data_quality_score", F.when(F.col("is_closed"), 100).otherwise(70))


def symbol_pool(symbol: Column, majors: tuple[str, ...] = MAJORS) -> Column:
    return F.when(symbol.isin(*majors), "A").otherwise("B")


def opportunity_id(symbol: Column, direction: Column, kind: Column, regime: Column, interval: str = "15m") -> Column:
    return F.concat_ws(":", symbol, direction, kind, regime, F.lit(interval))


#: Span of time (ms) whose signals of one opportunity are put in order together.
CHUNK = 4096 * 900_000


def changed(signals: DataFrame, key: str = "opportunity_id", order: str = "created_ms", chunk: int = CHUNK) -> DataFrame:
    """Signals whose level or status differs from the one before of the same opportunity: what a log that skips repetitions keeps."""
    state = F.struct("level", "lifecycle_status")
    return before(signals, [key], order, state, "_before", chunk).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)).drop("_before")


def opportunities(signals: DataFrame, key: str = "opportunity_id", order: str = "created_ms") -> DataFrame:
    """One row per opportunity: first and last time, and the last state."""
    last = F.max_by(F.struct("symbol", "direction", "lifecycle_status", "score", "level"), F.col(order))
    out = signals.groupBy(key).agg(F.min(order).alias("first_detected_ms"), F.max(order).alias("last_updated_ms"), last.alias("s"))
    return out.select(key, "s.symbol", "s.direction", "s.lifecycle_status", F.col("s.score").alias("current_score"), F.col("s.level").alias("current_level"), "first_detected_ms", "last_updated_ms")


def with_latest(signals: DataFrame, stored: DataFrame, key: str = "opportunity_id", order: str = "created_ms") -> DataFrame:
    """Signals with the last stored level and status of their opportunity."""
    latest = stored.groupBy(key).agg(F.max_by(F.struct("level", "lifecycle_status"), F.col(order)).alias("latest"))
    return signals.join(latest, key, "left").select(*signals.columns, F.col("latest.level").alias("latest_level"), F.col("latest.lifecycle_status").alias("latest_status"))


#: The way of entry of a signal without a plan.
NO_ENTRY = "confirmation_wait"


def candle_rows(candles: DataFrame) -> DataFrame:
    """Candles as rows of the store: times as ISO text, and their quality."""
    return candle_quality(candles).withColumns({"open_time": iso_time(F.col("open_time")), "close_time": iso_time(F.col("close_time"))})


def signal_rows(signals: DataFrame) -> DataFrame:
    """Signals as rows of the store: the plan's fields flat, NO_ENTRY where there is no plan, lists and the no-chase rule as JSON."""
    return signals.select(
        "id", "opportunity_id", "symbol", "direction", "signal_type", "lifecycle_status", "level", "score",
        F.coalesce("entry_mode", F.lit(NO_ENTRY)).alias("entry_mode"),
        "entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "theoretical_rr", "weighted_rr", "cost_adjusted_rr", "sl_distance_pct", "sl_atr_ratio", "btc_state", "market_regime",
        F.col("relative_strength").alias("relative_strength_score"),
        F.col("quality").alias("data_quality_score"),
        F.to_json("reasons").alias("reasons"),
        F.to_json("invalidation_rules").alias("invalidation_rules"),
        F.to_json("no_chase_rule").alias("no_chase_rule"),
        "created_ms",
    )


def appended(signals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows that a run adds to the store: signals whose level or status differs from the one before of their opportunity, be that one of the run or the last one ``stored``."""
    fresh = signals.withColumn("_new", F.lit(True))
    if stored is not None:
        last = stored.groupBy("opportunity_id").agg(F.max_by(F.struct("level", "lifecycle_status", "created_ms"), "created_ms").alias("l"))
        fresh = fresh.unionByName(last.select("opportunity_id", "l.*", F.lit(False).alias("_new")), allowMissingColumns=True)
    return signal_rows(changed(fresh).filter("_new"))


def with_relations(signals: DataFrame, opportunities_: DataFrame, notifications: DataFrame, results: DataFrame) -> DataFrame:
    """Signals with what refers to them: the opportunity they belong to, how many notifications, and the result if there is one."""
    sent = notifications.groupBy(F.col("signal_id").alias("id")).agg(F.count("*").alias("notifications"))
    ended = results.select(F.col("signal_id").alias("id"), "final_status", "final_r")
    own = opportunities_.select("opportunity_id", "first_detected_ms", "last_updated_ms")
    return signals.join(own, "opportunity_id").join(sent, "id", "left").join(ended, "id", "left").withColumn("notifications", F.coalesce("notifications", F.lit(0).cast("long")))


def sent_notifications(queued: DataFrame, ids: DataFrame, result: Column, at_ms: Column, error: Column) -> DataFrame:
    """Notifications after their message was sent, failed or skipped (``result``): those of ``ids`` get status, time and error; skipped ones stay queued."""
    hit = queued.join(ids.select("notification_id", F.lit(True).alias("_hit")).distinct(), "notification_id", "left")
    done = F.col("_hit").isNotNull() & result.isin("sent", "failed")
    return hit.withColumns({
        "status": F.when(done, result).otherwise(F.col("status")),
        "sent_at": F.when(done & (result == "sent"), iso_time(at_ms)),
        "error_message": F.when(done & (result == "failed"), error),
    }).drop("_hit")


def notification_status(queued: DataFrame, sent: DataFrame, failed: DataFrame) -> DataFrame:
    """Notifications with the status after sending; what is in neither table stays queued."""
    marks = sent.select("notification_id", F.lit("sent").alias("_s")).unionByName(failed.select("notification_id", F.lit("failed").alias("_s")))
    marks = marks.groupBy("notification_id").agg(F.max("_s").alias("_s"))
    return queued.join(marks, "notification_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def counters(evaluations: DataFrame) -> DataFrame:
    """One row of counts of evaluations."""
    good = F.col("level").isin("A", "S")
    return evaluations.agg(F.count("*").alias("generated"), F.count_if(good).alias("qualified"), F.count_if(F.col("level") == "S").alias("strong"), F.count_if(F.col("lifecycle_status") == "planned").alias("planned"))


def run_counters(candles: DataFrame, evaluations: DataFrame, logged: DataFrame, alerts: DataFrame, sent: int, failed: int) -> DataFrame:
    """The nine counters of a run's audit event, one row: ``logged`` are the signals that were new, ``alerts`` those of them that raise one."""
    good = F.col("level").isin("A", "S")
    counts = [
        candles.agg(F.count_distinct("symbol").alias("symbols"), F.count("*").alias("candles")),
        evaluations.agg(F.count("*").alias("generated"), F.count_if(good).alias("qualified")),
        alerts.agg(F.count("*").alias("strong_alerts")),
        logged.agg(F.count("*").alias("persisted_signals")),
        alerts.agg(F.count("*").alias("persisted_notifications")),
    ]
    out = counts[0]
    for one in counts[1:]:  # rows of one each
        out = out.crossJoin(one)
    return out.withColumns({"sent_emails": F.lit(sent).cast("long"), "failed_emails": F.lit(failed).cast("long")})


def planned(signals: DataFrame) -> DataFrame:
    """Signals whose plan is ready."""
    return signals.filter(F.col("lifecycle_status") == "planned")


def runnable(signals: DataFrame) -> DataFrame:
    """Signals that have a plan."""
    return signals.filter(F.col("entry_low").isNotNull())
