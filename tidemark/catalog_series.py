"""Named queries over unclean bars, the declared lifecycle and patterns, and series in pieces, with their SQL equivalents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark import catalog as base
from tidemark.dialect import HISTORICAL
from tidemark.operators import alerts, asof, breakout, indicators, lifecycle, metrics, orderstat, propagate, readmodel, risk, state
from tidemark.operators.ordered import numbered
from tidemark.plans import historical, live, oracle
from tidemark.shared import new_path, written
from tidemark.sources import candles as source
from tidemark.streaming import candles as streaming
from tidemark.streaming import keyed
from tidemark.streaming import outcomes as later

HOUR, BENCHMARK, SYMBOLS = 3_600_000, base.BENCHMARK, base.SYMBOLS
#: Bars of an hour, of which some are missing, open or flat; quality over half a day.
ROUGH = replace(HISTORICAL, horizon=24, interval_ms=HOUR, quality_bars=12)
ARCHIVE = 6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _bars(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    price = F.when(F.col("event_type") == "error", F.floor(F.col("value") / 200) * 200.0).otherwise(F.col("value"))
    rows = source.bucketed(events, F.col("event_type"), F.col("ts"), F.col("event_id"), price, HOUR)
    return rows.withColumn("is_closed", F.floor(F.col("open_time") / HOUR) % 41 != 3)


def _features(spark, d):
    return indicators.features(_bars(spark, d), ROUGH, HOUR)


def _evaluated(spark, d):
    return historical.evaluated_bars(_bars(spark, d), ROUGH, BENCHMARK)


def _signals(spark, d):
    return live.signals(_evaluated(spark, d))


_BARS = oracle.rough(HOUR)
_EV = oracle.evaluated(ROUGH, HOUR, _BARS)
_SIGNALS = base._SIGNALS.replace(oracle.evaluated(), _EV)
_long = lambda c: F.col(c).cast("bigint").alias(c)


# unclean bars, in which every branch occurs


@query(f"WITH {_EV} SELECT {', '.join(base.EVALUATION + base.PRICES)}, quality FROM ev")
def rough_evaluations(spark, d):
    return _evaluated(spark, d).select(*base.EVALUATION, *base.PRICES, "quality")


@query(f"WITH {oracle.features(ROUGH, HOUR, _BARS)} SELECT symbol, open_time, is_closed, quality, {oracle.r6('atr')} AS atr, {oracle.r6('volume_ratio')} AS volume_ratio FROM feat")
def rough_quality(spark, d):
    return _features(spark, d).select("symbol", "open_time", "is_closed", "quality", base.R6("atr"), base.R6("volume_ratio"))


@query(_SIGNALS + " SELECT id, symbol, level, score, lifecycle_status AS status FROM sig WHERE lifecycle_status = 'planned'")
def rough_planned(spark, d):
    return state.planned(_signals(spark, d)).select("id", "symbol", "level", "score", F.col("lifecycle_status").alias("status"))


@query(_SIGNALS + " SELECT id, entry_low, tp3 FROM sig WHERE eligible")
def rough_runnable(spark, d):
    return state.runnable(_signals(spark, d)).select("id", "entry_low", "tp3")


for _name, _of, _made in (
    ("rough_signal_rows", "signal_rows", lambda rows: state.signal_rows(rows).withColumn("weighted_rr", F.round("weighted_rr", 6)).drop("symbol", "direction", "theoretical_rr", "cost_adjusted_rr", "btc_state", "market_regime", "relative_strength_score", "created_ms")),
    ("rough_displayed", "display_strings", readmodel.displayed),
    ("rough_mail", "signal_email", lambda rows: alerts.single(rows).select("id", "subject", "body")),
    ("rough_summary_mail", "summary_email", lambda rows: alerts.summary(rows.withColumn("ord", F.col("symbol")), "created_ms")),
    ("rough_radar", "radar_rows", readmodel.radar),
    ("rough_changes", "signal_log_on_change", lambda rows: state.changed(rows).select("opportunity_id", "created_ms", "level", "lifecycle_status")),
):
    QUERIES[_name] = lambda spark, d, made=_made: made(_signals(spark, d))
    SQL[_name] = base.SQL[_of].replace(oracle.evaluated(), _EV)


@query(f"SELECT r.* FROM ({SQL['rough_signal_rows']}) r JOIN ({SQL['rough_changes']}) c ON r.id = c.opportunity_id || '@' || c.created_ms")
def stored_signals(spark, d):
    """Two runs, the second of which appends to what the first one stored."""
    path, signals = new_path(spark, "signals"), _signals(spark, d)
    state.appended(signals.filter("seq < 350")).write.parquet(path)
    state.appended(signals.filter("seq >= 350"), spark.read.parquet(path)).write.mode("append").parquet(path)
    return spark.read.parquet(path).withColumn("weighted_rr", F.round("weighted_rr", 6)).drop("symbol", "direction", "theoretical_rr", "cost_adjusted_rr", "btc_state", "market_regime", "relative_strength_score", "created_ms")


@query(f"WITH {oracle.outcomes(ROUGH, 24, HOUR, _BARS)} SELECT {base._OUT} FROM outc")
def rough_outcomes(spark, d):
    return base._outcome(historical.outcomes(_bars(spark, d), ROUGH, BENCHMARK))


@query(oracle.summary("symbol, level", base.FIRST, 24, HOUR, ROUGH, _BARS))
def rough_summary(spark, d):
    return metrics.summary(historical.trades(_bars(spark, d), ROUGH, BENCHMARK).filter(base.FIRST), ["symbol", "level"], symbols=SYMBOLS)


# the declared lifecycle

_UP = lambda c: f"(CASE WHEN k.direction = 'LONG' THEN b.high >= k.{c} ELSE b.low <= k.{c} END)"
_LEVEL_SQL = f"CASE WHEN (CASE WHEN k.direction = 'LONG' THEN b.low <= k.stop_loss ELSE b.high >= k.stop_loss END) THEN 'hit_sl' WHEN {_UP('tp3')} THEN 'hit_tp3' WHEN {_UP('tp2')} THEN 'hit_tp2' WHEN {_UP('tp1')} THEN 'hit_tp1' END"


@query(f"""WITH {_EV.replace('c0 AS', 'RECURSIVE c0 AS', 1)}, k AS MATERIALIZED (SELECT * FROM ev WHERE eligible), bars AS MATERIALIZED (SELECT symbol, seq, high, low, close, quality FROM feat),
met AS MATERIALIZED (SELECT k.symbol, k.seq, b.seq AS at, b.quality < 75 AS bad, b.low <= k.entry_high AND b.high >= k.entry_low AS touch, {_LEVEL_SQL} AS hit,
  CASE WHEN k.direction = 'LONG' THEN b.close < k.stop_loss ELSE b.close > k.stop_loss END AS broken, CASE WHEN k.direction = 'LONG' THEN b.close > k.no_chase_price ELSE b.close < k.no_chase_price END AS away
  FROM k JOIN bars b ON b.symbol = k.symbol AND b.seq > k.seq AND b.seq <= k.seq + {ROUGH.horizon + ARCHIVE}),
life AS (SELECT symbol, seq, seq AS at, 'planned' AS state FROM k UNION ALL
  SELECT l.symbol, l.seq, m.at, CASE WHEN m.at = l.seq + {ROUGH.horizon + ARCHIVE} THEN 'archived'
    WHEN m.at > l.seq + {ROUGH.horizon} THEN CASE WHEN state IN ('planned', 'waiting_entry', 'no_chase', 'entered') THEN 'expired' ELSE state END
    WHEN state = 'entered' THEN coalesce(hit, state)
    WHEN state IN ('planned', 'waiting_entry', 'no_chase') THEN CASE WHEN bad THEN 'invalidated' WHEN touch THEN coalesce(hit, 'entered') WHEN broken THEN 'invalidated' WHEN away THEN 'no_chase' ELSE 'waiting_entry' END
    ELSE state END FROM life l JOIN met m ON m.symbol = l.symbol AND m.seq = l.seq AND m.at = l.at + 1)
SELECT symbol, CAST(seq AS BIGINT) AS seq, CAST(at AS BIGINT) AS "at", state FROM life""".replace("l.at", 'l."at"').replace("m.at", 'm."at"').replace("AS at,", 'AS "at",').replace("CAST(at ", 'CAST("at" '))
def signal_lifecycle(spark, d):
    features = _features(spark, d)
    signals = _evaluated(spark, d).filter("eligible")
    return lifecycle.signal_states(signals, features, ROUGH.horizon, ARCHIVE).select("symbol", _long("seq"), _long("at"), "state")


_SIDE_RULES = " ".join(f"WHEN state = '{s}' AND event = '{e}' THEN '{to}'" for (s, e), to in lifecycle.OPPORTUNITY.rules.items())


@query(f"""WITH {_EV.replace('c0 AS', 'RECURSIVE c0 AS', 1)}, e AS MATERIALIZED (SELECT symbol, side, seq, row_number() OVER (PARTITION BY symbol, side ORDER BY seq) AS n, CASE WHEN quality < 75 THEN 'broken' WHEN direction <> side THEN 'quiet' ELSE lifecycle_status END AS event
  FROM ev, (SELECT unnest(['LONG', 'SHORT']) AS side)),
life AS (SELECT symbol, side, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'archived' AS state FROM (SELECT DISTINCT symbol, side FROM e) UNION ALL
  SELECT e.symbol, e.side, e.n, e.seq, CASE {_SIDE_RULES} ELSE state END FROM life l JOIN e ON e.symbol = l.symbol AND e.side = l.side AND e.n = l.n + 1)
SELECT symbol, side, CAST(seq AS BIGINT) AS seq, state FROM life WHERE n > 0""")
def opportunity_lifecycle(spark, d):
    return lifecycle.opportunity_states(_evaluated(spark, d)).select("symbol", "side", _long("seq"), "state")


# breakouts

PATTERN = breakout.Pattern()
_FOUND = f"""{oracle.features(ROUGH, HOUR, _BARS)}, f AS MATERIALIZED (SELECT symbol, seq, close, volume_ratio, structure_low, structure_high, atr, open_time FROM feat),
st AS MATERIALIZED (SELECT symbol, seq, structure_low AS range_low, structure_high AS range_high FROM f WHERE atr > 0 AND structure_high - structure_low <= {PATTERN.width} * atr),
x AS MATERIALIZED (SELECT s.symbol, s.seq, b.seq AS nth, b.seq - s.seq AS age, CASE WHEN b.close > range_high THEN 1 WHEN b.close < range_low THEN -1 ELSE 0 END AS side, b.volume_ratio >= {PATTERN.volume} AS strong
  FROM st s JOIN f b ON b.symbol = s.symbol AND b.seq > s.seq AND b.seq <= s.seq + {PATTERN.within + PATTERN.confirm}),
br AS (SELECT symbol, seq, min(nth) AS brk, arg_min(side, nth) AS side, arg_min(strong, nth) AS strong FROM x WHERE side <> 0 AND age <= {PATTERN.within} GROUP BY ALL),
n AS (SELECT symbol, seq, count(*) AS bars FROM x WHERE age <= {PATTERN.within} GROUP BY ALL),
af AS (SELECT b.symbol, b.seq, count(*) AS bars, min(CASE WHEN x.side = b.side THEN x.nth END) AS good, min(CASE WHEN x.side = -b.side THEN x.nth END) AS bad FROM br b JOIN x ON x.symbol = b.symbol AND x.seq = b.seq AND x.nth > b.brk AND x.nth <= b.brk + {PATTERN.confirm} WHERE b.strong GROUP BY ALL),
o AS (SELECT s.symbol, s.seq, range_low, range_high, CASE WHEN brk IS NULL AND coalesce(n.bars, 0) = {PATTERN.within} THEN 'timed_out' WHEN brk IS NULL THEN 'pending' WHEN NOT strong THEN 'drifted' WHEN good < coalesce(bad, good + 1) THEN CASE WHEN side > 0 THEN 'confirmed_up' ELSE 'confirmed_down' END
    WHEN bad IS NOT NULL OR coalesce(af.bars, 0) = {PATTERN.confirm} THEN 'failed' ELSE 'pending' END AS outcome,
  CASE WHEN brk IS NULL AND coalesce(n.bars, 0) = {PATTERN.within} THEN s.seq + {PATTERN.within} WHEN brk IS NULL THEN NULL WHEN NOT strong THEN brk WHEN good IS NOT NULL OR bad IS NOT NULL THEN least(good, bad) WHEN coalesce(af.bars, 0) = {PATTERN.confirm} THEN brk + {PATTERN.confirm} END AS decided
  FROM st s LEFT JOIN br USING (symbol, seq) LEFT JOIN n USING (symbol, seq) LEFT JOIN af USING (symbol, seq))"""


@query(f"WITH {_FOUND} SELECT symbol, CAST(seq AS BIGINT) AS seq, range_low, range_high, outcome, CAST(decided AS BIGINT) AS decided FROM o")
def breakout_outcomes(spark, d):
    return breakout.outcomes(_features(spark, d), PATTERN).select("symbol", _long("seq"), "range_low", "range_high", "outcome", _long("decided"))


_G = """, g AS (SELECT symbol, decided AS seq, CASE WHEN outcome = 'confirmed_up' THEN 'LONG' ELSE 'SHORT' END AS direction, count(*) AS setups, min(seq) AS first_setup FROM o WHERE outcome LIKE 'confirmed%' GROUP BY ALL),
j AS (SELECT f.* EXCLUDE (direction), g.direction, setups, first_setup, 0.0 AS relative_strength FROM g JOIN feat f ON f.symbol = g.symbol AND f.seq = g.seq)"""


@query(f"WITH {_FOUND}{_G}{oracle.scored(ROUGH, 'j')} SELECT symbol, CAST(seq AS BIGINT) AS seq, direction, setups, CAST(first_setup AS BIGINT) AS first_setup, 'volume_breakout' AS signal_type, 'breakout_confirm' AS entry_mode, {', '.join(base.PRICES)} FROM ev")
def breakout_signals(spark, d):
    features = _features(spark, d)
    rows = breakout.signals(features, breakout.outcomes(features, PATTERN), ROUGH)
    return rows.select("symbol", _long("seq"), "direction", "setups", _long("first_setup"), "signal_type", "entry_mode", *base.PRICES)


# corrected and late bars

#: Hours whose bars come late, and whose bars come with a wrong close first.
LATE, WRONG = (311, 5), (293, 7)


def _hour(part: tuple[int, int]):
    return F.floor(F.col("open_time") / HOUR) % part[0] == part[1]


def _first_seen(spark, d):
    """The bars as they are known at first."""
    bars = _bars(spark, d).filter(~_hour(LATE))
    return bars.withColumn("close", F.when(_hour(WRONG), F.col("low")).otherwise(F.col("close")))


_FIRST = _BARS.replace("candles AS", "every AS", 1) + f""",
candles AS (SELECT * REPLACE (CASE WHEN open_time // {HOUR} % {WRONG[0]} = {WRONG[1]} THEN low ELSE close END AS close) FROM every WHERE open_time // {HOUR} % {LATE[0]} <> {LATE[1]})"""
_RESULT = ", ".join(propagate.RESULT)


def _corrections(spark, d):
    before, after = _first_seen(spark, d), _bars(spark, d)
    corrections = after.filter(_hour(LATE) | _hour(WRONG))
    stored = written(propagate.whole(before, ROUGH, BENCHMARK), "stored")
    return stored, written(propagate.changes(stored, propagate.corrected(before, corrections), corrections, ROUGH, BENCHMARK)[1], "changes")


@query(f"WITH {oracle.outcomes(ROUGH, 24, HOUR, _BARS)} SELECT {_RESULT} FROM outc")
def corrected_outcomes(spark, d):
    return propagate.applied(*_corrections(spark, d))


@query(f"""SELECT '-' AS op, * FROM (SELECT * FROM (WITH {oracle.outcomes(ROUGH, 24, HOUR, _FIRST)} SELECT {_RESULT} FROM outc) EXCEPT SELECT * FROM (WITH {oracle.outcomes(ROUGH, 24, HOUR, _BARS)} SELECT {_RESULT} FROM outc))
UNION ALL SELECT '+', * FROM (SELECT * FROM (WITH {oracle.outcomes(ROUGH, 24, HOUR, _BARS)} SELECT {_RESULT} FROM outc) EXCEPT SELECT * FROM (WITH {oracle.outcomes(ROUGH, 24, HOUR, _FIRST)} SELECT {_RESULT} FROM outc))""")
def correction_changes(spark, d):
    return _corrections(spark, d)[1]


# streams with state per key

#: Parts in which a stream's rows come, and the part before which a stream that takes several in a run is stopped and started again.
SLICES, RESTART = 6, 3
_CLOSED = oracle.candles().replace("candles AS", "every AS", 1) + f""",
candles AS (SELECT * FROM every WHERE close_time <= (SELECT max(close_time) FROM every) - {base.H4})"""


def _arriving(spark, d, path):
    """A function that lets the events of a slice of their time arrive, and the stream that reads them.

    A slice is as many files as the tasks that read it write, however many ticks it holds. A run of the
    stream takes what has arrived as one batch, so each slice has a run of its own.
    """
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("price"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    width = (high - low) / SLICES if low is not None else None

    def arrive(i: int) -> None:
        part = rows if width is None else rows.filter((F.col("ts") >= low + width * i) & ((F.col("ts") < low + width * (i + 1)) if i < SLICES - 1 else F.lit(True)))
        part.write.mode("append").parquet(f"{path}/in")

    return arrive, lambda: spark.readStream.schema(rows.schema).parquet(f"{path}/in")


@query(base._SIGNALS.replace(oracle.evaluated(), oracle.evaluated(base.NOW, base.H4, _CLOSED)) + " SELECT opportunity_id, created_ms, level, lifecycle_status FROM (SELECT *, lag(level) OVER w AS l0, lag(lifecycle_status) OVER w AS s0 FROM sig WINDOW w AS (PARTITION BY opportunity_id ORDER BY created_ms)) WHERE l0 IS NULL OR l0 <> level OR s0 <> lifecycle_status")
def stream_keyed_log(spark, d):
    path = new_path(spark, "stream-keyed")
    arrive, ticks = _arriving(spark, d, path)
    for i in range(SLICES):  # each run goes on from the checkpoints of the one before
        arrive(i)
        keyed.signals_to(ticks(), path, base.NOW, BENCHMARK, live.signals, "4 hours", None).awaitTermination()
        if i + 1 in (RESTART, SLICES):
            keyed.changes_to(spark, path, None).awaitTermination()
    return spark.read.schema(keyed.SIGNAL).parquet(f"{path}/log")


# order statistics, joins in time

SPANS = (7, 30, 90)
_METRICS = base._METRICS.replace(oracle.candles(), oracle.candles(HOUR)).replace(f"open_time // {base.H4}", f"open_time // {HOUR}")


@query(_METRICS + " SELECT a.symbol, a.open_time, " + ", ".join(f"{oracle.js(f'count_if(b.{v} <= a.{v} AND b.open_time >= a.open_time - {d * 86_400_000}) / CAST(count_if(b.open_time >= a.open_time - {d * 86_400_000}) AS DOUBLE) * 100')} AS {v}_percentile_{d}d" for v in ("funding_rate", "open_interest") for d in SPANS) + " FROM m a JOIN m b ON a.symbol = b.symbol AND b.open_time <= a.open_time GROUP BY ALL")
def metric_percentiles(spark, d):
    rate = ((F.col("trades") * 7 + F.floor(F.col("open_time") / HOUR)) % 50 - 25).cast("double") * F.lit(1e-4)
    rows = source.from_events(spark, d, HOUR).select("symbol", "open_time", F.col("quote_volume").alias("open_interest"), rate.alias("funding_rate"))
    return orderstat.percentiles(rows, ["funding_rate", "open_interest"], list(SPANS)).drop("open_interest", "funding_rate")


_QUOTES = "q AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS quoted_at, arg_max(value, event_id) AS rate, max(event_id) AS quote FROM events WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"WITH {oracle.candles(HOUR)}, {_QUOTES} SELECT c.symbol, c.open_time, c.close, q.quoted_at, q.rate, q.quote FROM candles c ASOF LEFT JOIN q ON c.symbol = q.symbol AND c.open_time >= q.quoted_at")
def quotes_asof(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").filter("value is not null")
    quotes = events.select(F.col("event_type").alias("symbol"), F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000)).alias("quoted_at"), F.col("value").alias("rate"), F.col("event_id").alias("quote"))
    return asof.asof(source.from_events(spark, d, HOUR).select("symbol", "open_time", "close"), quotes, ["symbol"], "open_time", "quoted_at", "quote")


_ACTIVE = f"{oracle.trades()}, active AS (SELECT CAST(step AS INTEGER) AS step, symbol, direction, open_time AS begins, open_time + duration * {base.H4} AS ends FROM trades)"


def _active(spark, d):
    return base._trades(spark, d).select("step", "symbol", "direction", F.col("open_time").alias("begins"), (F.col("open_time") + F.col("duration") * base.H4).alias("ends"))


@query(f"""WITH {_ACTIVE}, s AS (SELECT step, begins AS "at", 1 AS n, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS net FROM active UNION ALL SELECT step, ends + 1, -1, CASE WHEN direction = 'LONG' THEN -1 ELSE 1 END FROM active),
t AS (SELECT step, "at", sum(n) AS n, sum(net) AS net FROM s GROUP BY ALL) SELECT step, "at", CAST(sum(n) OVER w AS BIGINT) AS trades_active, CAST(sum(net) OVER w AS BIGINT) AS net_active FROM t WINDOW w AS (PARTITION BY step ORDER BY "at")""")
def trade_exposure(spark, d):
    return asof.exposure(_active(spark, d), "begins", "ends", {"trades": F.lit(1), "net": F.when(F.col("direction") == "LONG", 1).otherwise(-1)}, ["step"])


@query(f"""WITH {_ACTIVE} SELECT a.step, a.symbol AS one, b.symbol AS other, count(*) AS pairs, CAST(sum(least(a.ends, b.ends) - greatest(a.begins, b.begins) + 1) AS BIGINT) AS common_ms
FROM active a JOIN active b ON a.step = b.step AND a.symbol < b.symbol AND a.begins <= b.ends AND b.begins <= a.ends GROUP BY ALL""")
def trades_together(spark, d):
    rows = written(_active(spark, d), "active")
    met = asof.overlapping(rows, rows, "begins", "ends", 24 * base.H4).filter((F.col("l.step") == F.col("r.step")) & (F.col("l.symbol") < F.col("r.symbol")))
    common = F.least("l.ends", "r.ends") - F.greatest("l.begins", "r.begins") + 1
    return met.groupBy(F.col("l.step").alias("step"), F.col("l.symbol").alias("one"), F.col("r.symbol").alias("other")).agg(F.count("*").alias("pairs"), F.sum(common).alias("common_ms"))


# all summaries in one pass

_SETS = {
    "by_polling": (["polling_minutes"], "true"),
    "optimized_by_polling": (["polling_minutes"], base.STRONG),
    "by_symbol": (["symbol"], base.FIRST),
    "optimized_by_symbol": (["symbol"], f"{base.FIRST} AND {base.STRONG}"),
    "by_level": (["level"], base.FIRST),
    "by_direction": (["direction"], base.FIRST),
    "by_symbol_direction": (["symbol", "direction"], base.FIRST),
}
_BY = {"polling_minutes": "INTEGER", "symbol": "VARCHAR", "level": "VARCHAR", "direction": "VARCHAR"}
_MEASURED = "trades, win_rate, entry_fill_rate, avg_r, total_r, median_r, profit_factor, avg_mfe, avg_mae, avg_score, status_counts, max_drawdown, max_losing_streak, rank"


@query(" UNION ALL ".join(f"SELECT '{name}' AS grouping, {', '.join(k if k in keys else f'CAST(NULL AS {kind}) AS {k}' for k, kind in _BY.items())}, {_MEASURED} FROM ({oracle.summary(', '.join(keys), where)})" for name, (keys, where) in _SETS.items()))
def summary_sets(spark, d):
    sets = {name: (keys, F.expr(where)) for name, (keys, where) in _SETS.items()}
    return metrics.summary_sets(written(base._trades(spark, d), "trades"), sets, symbols=SYMBOLS)


# moving and session windows


def _batch_ticks(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("price"))


HOP = ["symbol", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trades"]
_T0 = "t0 AS (SELECT event_type AS symbol, ts, epoch_us(ts) // 1000 AS ms, event_id AS tie, value AS price FROM events WHERE value IS NOT NULL)"
_HOPPED = f"""WITH {_T0}, h AS (SELECT *, unnest(range(4)) AS back FROM t0), g AS (SELECT *, CAST(floor(ms / 900000.0) * 900000 AS BIGINT) - back * 900000 AS open_time FROM h)
SELECT symbol, open_time, open_time + 3599999 AS close_time, arg_min(price, (ts, tie)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tie)) AS close, CAST(count(*) AS DOUBLE) AS volume, {oracle.r6('sum(price)')} AS quote_volume, CAST(count(*) AS INTEGER) AS trades FROM g GROUP BY symbol, open_time"""
_SESSIONS = f"""WITH {_T0}, n AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS begins FROM t0 WINDOW w AS (PARTITION BY symbol ORDER BY ts, tie)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY symbol ORDER BY ts, tie) AS run FROM n) SELECT symbol, min(ms) AS "start", max(ms) + 7200000 AS "end", count(*) AS ticks, min(price) AS low, max(price) AS high FROM r GROUP BY symbol, run"""
#: What a stream has closed by its end: windows up to the newest tick less the time that ticks may be late.
_UNTIL = "(SELECT epoch_us(max(ts)) // 1000 - 1800000 FROM events WHERE value IS NOT NULL)"


@query(_HOPPED)
def hopping_bars(spark, d):
    return streaming.hopping(_batch_ticks(spark, d)).select(*HOP)


@query(_SESSIONS)
def session_runs(spark, d):
    return streaming.sessions(_batch_ticks(spark, d))


def _streamed(spark, d, made, name):
    """The rows that a stream in append mode gives over the slices, stopped and started again between any two."""
    path = new_path(spark, name)
    arrive, ticks = _arriving(spark, d, path)
    for i in range(SLICES):
        arrive(i)
        rows = made(ticks())
        rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query(f"SELECT * FROM ({_HOPPED}) WHERE close_time + 1 <= {_UNTIL}")
def stream_hopping_bars(spark, d):
    return _streamed(spark, d, streaming.hopping, "hopping").select(*HOP)


@query(f'SELECT * FROM ({_SESSIONS}) WHERE "end" <= {_UNTIL}')
def stream_session_runs(spark, d):
    return _streamed(spark, d, streaming.sessions, "sessions")


# outcomes as a stream


@query(f"WITH {oracle.outcomes()} SELECT {base._OUT.replace('level, score, ', '')} FROM outc")
def stream_outcomes(spark, d):
    path = new_path(spark, "stream-outcomes")
    bars = written(numbered(base._candles(spark, d)).select("symbol", "seq", "open_time", "high", "low"), "bars")
    raised = written(historical.candidates(base._evaluated(spark, d), base.HIST).select(*later.PLAN, "open_time"), "raised")
    low, high = bars.agg(F.min("open_time"), F.max("open_time")).first()
    width = ((high - low) // SLICES + 1) if low is not None else 1
    ahead = 10 * base.HIST.horizon * base.H4

    def arrive(rows, name, first, end, last):
        for i in range(first, end):
            rows.filter(F.floor((F.col("open_time") - low) / width) == i).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
        if last and high is not None:  # the end of the stream: a later row of a symbol that the other stream doesn't have
            rows.limit(1).withColumns({"symbol": F.lit(f"end of {name}"), "open_time": F.lit(high + ahead)}).coalesce(1).write.mode("append").parquet(f"{path}/{name}")

    read = lambda rows, name: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")
    for first, end in ((0, RESTART), (RESTART, SLICES)):
        arrive(raised, "signals", first, end, end == SLICES)
        arrive(bars, "bars", first, end, end == SLICES)
        out = later.outcomes(read(raised, "signals"), read(bars, "bars"), base.HIST)
        out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    names = [c for c in base.OUTCOME if c not in ("level", "score")]
    return spark.read.schema(out.schema).parquet(f"{path}/out").select(*(_long(c) if c == "seq" else F.col(c) for c in names))


# the declared breaker, over all symbols


for _name, _n, _least in (("market_breaker", risk.BREAKER_TRADES, risk.BREAKER_LEAST), ("market_breaker_short", 3, 0.2)):
    QUERIES[_name] = lambda spark, d, n=_n, least=_least: risk.market_breaker(historical.trades(_bars(spark, d), ROUGH, BENCHMARK), n, least).select("step", "symbol", "open_time", "level", "paused")
    SQL[_name] = f"""WITH {oracle.trades(ROUGH, 24, HOUR, _BARS)} SELECT CAST(step AS INTEGER) AS step, symbol, open_time, level, (count(*) OVER w = {_n} AND avg(final_r) OVER w < {_least}) AS paused
FROM trades WINDOW w AS (PARTITION BY step, level ORDER BY open_time, symbol ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)"""


@query(f"""WITH {oracle.trades(ROUGH, 24, HOUR, _BARS)}, n AS (SELECT *, row_number() OVER (PARTITION BY step, symbol ORDER BY seq) AS i FROM trades),
r AS (SELECT step, symbol, seq, i - coalesce(max(CASE WHEN final_status <> 'hit_sl' THEN i END) OVER (PARTITION BY step, symbol ORDER BY seq), 0) AS stops FROM n)
SELECT CAST(r.step AS INTEGER) AS step, f.symbol, CAST(f.seq AS BIGINT) AS seq, CAST(coalesce(stops, 0) AS BIGINT) AS stops, coalesce(stops, 0) >= 5 AS only_strong, f.atr >= f.close * {risk.WILD} AS alerts_only, f.quality < 75 AS symbol_paused FROM feat f LEFT JOIN r ON f.symbol = r.symbol AND f.seq = r.seq""")
def rough_guard(spark, d):
    trades = risk.stops_in_a_row(historical.trades(_bars(spark, d), ROUGH, BENCHMARK)).select("step", "symbol", "seq", "stops")
    rows = _features(spark, d).select("symbol", "seq", "atr", "close", "quality").join(trades, ["symbol", "seq"], "left")
    stops = F.coalesce("stops", F.lit(0))
    out = risk.guarded(rows, stops, F.col("atr") >= F.col("close") * risk.WILD, F.col("quality"))
    return out.select("step", "symbol", _long("seq"), stops.cast("bigint").alias("stops"), "only_strong", "alerts_only", "symbol_paused")


# the read model and symbol lists over given tables


@query(_SIGNALS + f""", v AS (SELECT id, unnest([level, lifecycle_status, direction, market_regime]) AS value FROM sig)
SELECT id, value, CASE WHEN value LIKE '%S%' OR value LIKE '%planned%' THEN 'green' WHEN value LIKE '%A%' OR value LIKE '%trend%' THEN 'blue' WHEN value LIKE '%B%' OR value LIKE '%watching%' THEN 'yellow' WHEN value LIKE '%SHORT%' THEN 'red' ELSE '' END AS color FROM v""")
def signal_badges(spark, d):
    rows = _signals(spark, d).select("id", F.explode(F.array("level", "lifecycle_status", "direction", "market_regime")).alias("value"))
    return rows.withColumn("color", readmodel.badge(F.col("value")))


@query("""WITH g AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), n AS (SELECT user_id, ' ' || string_agg(event_type, ', ,' ORDER BY first) || ',' AS names FROM g GROUP BY user_id),
u AS (SELECT user_id, list_filter(list_transform(string_split(names, ','), lambda x: upper(trim(x))), lambda x: x <> '') AS l FROM n),
e AS (SELECT user_id, unnest(list_prepend('VIEW', l)) AS symbol, unnest(range(len(l) + 1)) AS i FROM u), f AS (SELECT user_id, symbol, min(i) AS i FROM e GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INTEGER) AS pos, symbol FROM f""")
def user_universe(spark, d):
    # the kinds of events of a user, of which there are few, in the order in which they came, as an unclean list
    kinds = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    names = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("e"))
    names = names.select("user_id", F.concat(F.lit(" "), F.array_join("e.event_type", ", ,"), F.lit(",")).alias("names"))
    return names.select("user_id", F.posexplode(source.universe(F.col("names"), "VIEW")).alias("pos", "symbol"))


for _name, _least in (("planned_or_samples", 1000), ("planned_or_samples_found", 70)):
    QUERIES[_name] = lambda spark, d, least=_least: readmodel.with_fallback(_signals(spark, d).filter(f"score >= {least}").select("id", "level"), _signals(spark, d).filter("level = 'S'").select("id", "level"))
    SQL[_name] = _SIGNALS + f" SELECT id, level FROM sig WHERE score >= {_least} UNION ALL SELECT id, level FROM sig WHERE level = 'S' AND NOT EXISTS (SELECT 1 FROM sig WHERE score >= {_least})"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
