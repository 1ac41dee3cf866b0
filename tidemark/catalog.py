"""Named queries of the radar and backtest engine, with their SQL equivalents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.dialect import ALERT_EXCLUDED, HISTORICAL, LIVE
from tidemark.functions import js
from tidemark.operators import alerts, indicators, metrics, outcome, plan, readmodel, report, risk, schedule, scoring, state
from tidemark.operators.ordered import numbered
from tidemark.plans import historical, live, oracle
from tidemark.shared import new_path, written
from tidemark.sources import candles as source
from tidemark.streaming import candles as streaming

H4, M15, WEEK, BENCHMARK, SYMBOLS = oracle.H4, 900_000, oracle.WEEK, "view", oracle.SYMBOLS
HIST = replace(HISTORICAL, horizon=24, interval_ms=H4)
NOW = replace(LIVE, interval_ms=H4)
#: The backtest as it is run in production: bars of 15 minutes, a horizon of 96.
HIST_15M = replace(HISTORICAL, interval_ms=M15)
R6 = lambda c: js.js_round(F.col(c), 1e6).alias(c)
BARS = ["symbol", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trades", "is_closed"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _candles(spark, d):
    return source.from_events(spark, d, H4)


def _features(spark, d, dialect=HIST):
    return indicators.features(_candles(spark, d), dialect, H4)


def _evaluated(spark, d):
    return historical.evaluated_bars(_candles(spark, d), HIST, BENCHMARK)


def _trades(spark, d):
    return historical.trades(_candles(spark, d), HIST, BENCHMARK)


# sources


@query(f"WITH {oracle.candles()} SELECT {', '.join(BARS)} FROM candles")
def candles_from_events(spark, d):
    return _candles(spark, d).select(*BARS)


@query(f"""WITH c0 AS (SELECT c_mktsegment AS symbol, CAST(floor(epoch_ms(o_orderdate) / {WEEK}.0) * {WEEK} AS BIGINT) AS open_time, epoch_ms(o_orderdate) AS ts_ms, o_orderkey AS tie, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT symbol, open_time, open_time + {WEEK} - 1 AS close_time, arg_min(price, (ts_ms, tie)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ms, tie)) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(price), 2) AS quote_volume, CAST(count(*) AS INTEGER) AS trades, true AS is_closed FROM c0 GROUP BY ALL""")
def candles_from_orders(spark, d):
    return source.from_orders(spark, d, WEEK).select(*BARS).withColumn("quote_volume", F.round("quote_volume", 2))


def _klines(spark, d):
    bars = _candles(spark, d)
    fields = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "volume", "quote_volume", "trades"]
    raw = F.to_json(F.array(F.array(*(F.col(f).cast("string") for f in fields))))
    wrapped = F.when(F.col("open_time") / H4 % 2 == 0, raw).otherwise(F.concat(F.lit('{"value":'), raw, F.lit("}")))
    return bars.select("symbol", F.lit("4h").alias("interval"), wrapped.alias("raw"), "close_time")


def _normalized(spark, d, dialect=NOW):
    rows = _klines(spark, d)
    return source.normalized(rows.crossJoin(F.broadcast(source.latest_close(rows))), dialect, F.col("now"))


@query(f"""WITH {oracle.candles()}, n AS (SELECT max(close_time) AS now FROM candles)
SELECT symbol, '4h' AS interval, open_time, close_time, open, high, low, close, volume, quote_volume, trades, volume AS taker_buy_volume, quote_volume AS taker_buy_quote_volume, close_time < now AS is_closed FROM candles, n""")
def normalize_klines(spark, d):
    return _normalized(spark, d)


@query(f"""WITH {oracle.candles()}, n AS (SELECT max(close_time) AS now FROM candles)
SELECT symbol, open_time, close_time <= now AS is_closed FROM candles, n""")
def normalize_klines_hist(spark, d):
    return _normalized(spark, d, HIST).select("symbol", "open_time", "is_closed")


@query(f"""WITH {oracle.candles()} SELECT symbol, open_time, close + 1 AS close FROM candles WHERE trades % 2 = 0 UNION ALL SELECT symbol, open_time, close FROM candles WHERE trades % 2 = 1""")
def dedupe_last_wins(spark, d):
    bars = _candles(spark, d).select("symbol", "open_time", "close", "trades")
    again = bars.filter("trades % 2 = 0").withColumn("close", F.col("close") + 1)
    twice = bars.withColumn("ingest_seq", F.lit(0)).unionByName(again.withColumn("ingest_seq", F.lit(1)))
    return source.deduped(twice).select("symbol", "open_time", "close")


@query("SELECT CAST(i AS INTEGER) AS pos, s AS symbol FROM (VALUES (0, 'BTCUSDT'), (1, 'ETHUSDT'), (2, 'SOLUSDT')) t(i, s)")
def symbol_universe(spark, d):
    return spark.range(1).select(F.posexplode(source.universe(F.lit(" ethusdt, SOLUSDT ,, btcusdt"))).alias("pos", "symbol"))


@query(f"""WITH {oracle.candles()}, n AS (SELECT max(close_time) AS now FROM candles) SELECT symbol, open_time, close FROM candles, n WHERE close_time < now""")
def closed_only(spark, d):
    return _normalized(spark, d).filter("is_closed").select("symbol", "open_time", "close")


# indicators

for _name, _cols, _dialect in (
    ("true_range", ["true_range"], HIST),
    ("atr14", ["atr"], HIST),
    ("volume_ratio_live", ["volume_ratio"], NOW),
    ("volume_ratio_hist", ["volume_ratio"], HIST),
    ("structure20", ["structure_low", "structure_high"], HIST),
    ("move16", ["move"], HIST),
    ("data_quality_prefix", ["quality"], HIST),
    ("data_quality_bounded", ["quality"], NOW),
):
    QUERIES[_name] = lambda spark, d, cols=_cols, dialect=_dialect: _features(spark, d, dialect).select("symbol", "open_time", *map(R6, cols))
    SQL[_name] = f"WITH {oracle.features(_dialect)} SELECT symbol, open_time, {', '.join(f'{oracle.r6(c)} AS {c}' for c in _cols)} FROM feat"


@query(f"WITH {oracle.features(HIST)} SELECT symbol, open_time, direction FROM feat")
def direction9(spark, d):
    return _features(spark, d).select("symbol", "open_time", "direction")


@query(f"WITH {oracle.features(HIST)} SELECT a.symbol, a.open_time, {oracle.r6('a.move - b.move')} AS relative_strength FROM feat a JOIN feat b ON a.open_time = b.open_time AND b.symbol = 'view'")
def relative_strength16(spark, d):
    return indicators.with_benchmark(_features(spark, d), BENCHMARK).select("symbol", "open_time", R6("relative_strength"))


@query(f"WITH {oracle.features(HIST)} SELECT a.symbol, a.open_time, CAST(a.seq AS BIGINT) AS seq, CAST(b.seq AS BIGINT) AS benchmark_seq FROM feat a JOIN feat b ON a.open_time = b.open_time AND b.symbol = 'view'")
def benchmark_join(spark, d):
    return indicators.with_benchmark(_features(spark, d), BENCHMARK).select("symbol", "open_time", F.col("seq").cast("bigint").alias("seq"), F.col("benchmark_seq").cast("bigint").alias("benchmark_seq"))


# scores and plans

EVALUATION = ["symbol", "open_time", "direction", "score", "level", "lifecycle_status", "btc_state", "market_regime", "eligible", "no_chase"]
PRICES = ["entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "sl_distance_pct", "sl_atr_ratio", "no_chase_price"]


@query(f"WITH {oracle.evaluated()} SELECT {', '.join(EVALUATION + PRICES)} FROM ev")
def evaluate_bars_hist(spark, d):
    return _evaluated(spark, d).select(*EVALUATION, *PRICES)


@query(f"WITH {oracle.latest()} SELECT {', '.join(EVALUATION + PRICES)} FROM ev")
def evaluate_latest_live(spark, d):
    return live.latest(_candles(spark, d), NOW, BENCHMARK).select(*EVALUATION, *PRICES)


@query(f"WITH {oracle.latest()} SELECT symbol, {oracle.r6('relative_strength')} AS relative_strength FROM j")
def latest_cross_benchmark(spark, d):
    return live.latest(_candles(spark, d), NOW, BENCHMARK).select("symbol", R6("relative_strength"))


@query(f"WITH {oracle.evaluated()} SELECT symbol, open_time, score, level FROM ev")
def score_level(spark, d):
    return _evaluated(spark, d).select("symbol", "open_time", "score", "level")


@query("""SELECT event_id, CASE WHEN f IS NULL THEN 6.0 WHEN abs(f) < 0.0005 THEN 8.0 WHEN abs(f) < 0.001 THEN 6.0 WHEN abs(f) < 0.002 THEN 4.0 ELSE 2.0 END::DOUBLE AS live_points,
CASE WHEN f IS NULL THEN 5.0 WHEN abs(f) < 0.0002 THEN 8.0 WHEN abs(f) < 0.0005 THEN 5.0 ELSE 2.0 END::DOUBLE AS historical_points FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 50 - 25) * 1e-4 END AS f FROM events)""")
def funding_health(spark, d):
    rate = F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise((F.col("event_id") % 50 - 25) * F.lit(1e-4))
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", scoring.funding_points(rate, LIVE).alias("live_points"), scoring.funding_points(rate, HISTORICAL).alias("historical_points"))


@query(f"""WITH {oracle.evaluated()} SELECT symbol, open_time, {oracle.r6('least(10.0, greatest(0.0, quality / 10))')} AS quality_points, CASE WHEN aligned THEN 10.0 ELSE 4.0 END::DOUBLE AS aligned_points,
{oracle.r6('least(1.0, greatest(0.0, volume_ratio / 2)) * 8')} AS volume_points, {oracle.r6('least(6.0, abs(relative_strength))')} AS strength_points FROM ev""")
def score_components(spark, d):
    rows = _evaluated(spark, d)
    terms = scoring.components(F.col("quality"), scoring.aligned(F.col("direction"), F.col("relative_strength")), F.col("volume_ratio"), F.col("relative_strength"), F.lit(None).cast("double"), F.lit(None).cast("double"), HIST, F.lit(plan.WEIGHTED_RR), F.lit(5.0))
    names = ["quality_points", "aligned_points", "volume_points", "strength_points"]
    return rows.select("symbol", "open_time", *(terms[n].alias(n) for n in names)).select("symbol", "open_time", *map(R6, names))


@query(f"WITH {oracle.evaluated()} SELECT symbol, open_time, btc_state, market_regime FROM ev")
def regime_state(spark, d):
    return _evaluated(spark, d).select("symbol", "open_time", "btc_state", "market_regime")


@query(f"WITH {oracle.evaluated()} SELECT symbol, open_time, direction, {', '.join(PRICES)} FROM ev")
def trading_plan_long_short(spark, d):
    return _evaluated(spark, d).select("symbol", "open_time", "direction", *PRICES)


@query("""SELECT o_orderkey, CASE WHEN l THEN (104.0 - 94.0 <= 0) OR p > 104 + 10 ELSE (106.0 - 100.0 <= 0) OR p < 100.0 - 6.0 END AS no_chase FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS l, 80 + o_orderkey % 50 AS p FROM orders)""")
def no_chase(spark, d):
    long = F.col("o_orderkey") % 2 == 0
    stop = F.when(long, F.lit(94.0)).otherwise(F.lit(106.0))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", plan.no_chase(F.when(long, "LONG").otherwise("SHORT"), (80 + F.col("o_orderkey") % 50).cast("double"), F.lit(100.0), F.lit(104.0), stop).alias("no_chase"))


# outcomes, trades and summaries

OUTCOME = ["symbol", "seq", "direction", "level", "score", "entry_hit", "final_status", "final_r", "mfe", "mae", "duration"]
_OUT = ", ".join("CAST(seq AS BIGINT) AS seq" if c == "seq" else c for c in OUTCOME)


def _outcome(df):
    return df.select(*(F.col(c).cast("bigint").alias(c) if c == "seq" else F.col(c) for c in OUTCOME))


@query(f"WITH {oracle.outcomes()} SELECT {_OUT} FROM outc")
def outcomes(spark, d):
    return _outcome(historical.outcomes(_candles(spark, d), HIST, BENCHMARK))


@query(f"""SELECT l_orderkey, l_linenumber, {oracle.js('r - sign(r) * (CAST(0.001 AS DOUBLE) + CAST(0.0005 AS DOUBLE)) * 2')} AS final_r FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 5 - 1 AS DOUBLE) AS r FROM lineitem)""")
def outcome_costs(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", outcome.with_costs((F.col("l_linenumber") % 5 - 1).cast("double"), LIVE.fee, LIVE.slippage).alias("final_r"))


@query(f"WITH {oracle.evaluated()} SELECT symbol, open_time, CAST(s.step AS INTEGER) AS step FROM ev, (SELECT unnest([1, 2, 4]) AS step) s WHERE (seq - 40) % s.step = 0")
def polling_candidates(spark, d):
    return schedule.strided(_evaluated(spark, d), HIST).select("symbol", "open_time", "step")


@query(f"WITH {oracle.trades()} SELECT CAST(step AS INTEGER) AS step, polling_minutes, {_OUT} FROM trades")
def trades_greedy(spark, d):
    rows = _trades(spark, d)
    return rows.select("step", "polling_minutes", *(F.col(c).cast("bigint").alias(c) if c == "seq" else F.col(c) for c in OUTCOME))


STRONG, FIRST = "level = 'S' AND symbol <> 'purchase'", "step = 1"
for _name, _keys, _where in (
    ("summary_by_polling", ["polling_minutes"], "true"),
    ("summary_optimized_by_polling", ["polling_minutes"], STRONG),
    ("summary_by_symbol", ["symbol"], FIRST),
    ("summary_optimized_by_symbol", ["symbol"], f"{FIRST} AND {STRONG}"),
    ("summary_by_level", ["level"], FIRST),
    ("summary_by_direction", ["direction"], FIRST),
    ("summary_by_symbol_direction", ["symbol", "direction"], FIRST),
):

    def _summary(spark, d, keys=_keys, only=_where):
        # written, as a summary reads trades twice
        return metrics.summary(written(_trades(spark, d), "trades").filter(only), keys, symbols=SYMBOLS)

    QUERIES[_name] = _summary
    SQL[_name] = oracle.summary(", ".join(_keys), _where)


@query(f"WITH {oracle.trades()} SELECT polling_minutes, final_status, count(*) AS n FROM trades GROUP BY ALL")
def status_histogram(spark, d):
    return metrics.status_histogram(_trades(spark, d), ["polling_minutes"])


@query(f"SELECT polling_minutes, max_drawdown FROM ({oracle.summary('polling_minutes')})")
def max_drawdown(spark, d):
    return metrics.max_drawdown(_trades(spark, d), ["polling_minutes"], SYMBOLS)


@query(f"SELECT symbol, max_losing_streak FROM ({oracle.summary('symbol')})")
def losing_streak(spark, d):
    return metrics.losing_streak(_trades(spark, d), ["symbol"], SYMBOLS)


@query(f"WITH {oracle.trades()} SELECT polling_minutes, {oracle.js('median(final_r)')} AS median_r FROM trades GROUP BY ALL")
def median_r(spark, d):
    return _trades(spark, d).groupBy("polling_minutes").agg(metrics.basic(1e4)["median_r"].alias("median_r"))


@query(f"""WITH {oracle.candles()} SELECT symbol, count(*) AS bars, strftime(make_timestamp(min(open_time) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS first_open, strftime(make_timestamp(max(open_time) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_open FROM candles GROUP BY symbol""")
def data_coverage(spark, d):
    return metrics.coverage(_candles(spark, d))


_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
_TRADE = ["time", "symbol", "direction", "level", "score", "final_status", "final_r"]


@query(f"WITH {oracle.trades()} SELECT {_ISO.format('open_time')} AS time, {', '.join(_TRADE[1:])} FROM trades WHERE step = 1 ORDER BY {oracle.PLACE}, seq LIMIT 20")
def sample_trades(spark, d):
    return report.first_trades(_trades(spark, d), SYMBOLS).select(*_TRADE)


@query(f"WITH {oracle.evaluated()} SELECT count(*) AS generated, CAST(count_if(level IN ('A', 'S')) AS BIGINT) AS qualified, CAST(count_if(level = 'S') AS BIGINT) AS strong, CAST(count_if(lifecycle_status = 'planned') AS BIGINT) AS planned FROM ev")
def sync_counters(spark, d):
    return state.counters(_evaluated(spark, d))


# stored state

_SIGNALS = f"""WITH {oracle.evaluated()}, sig AS (SELECT *, symbol || ':' || direction || ':trend_pullback:' || market_regime || ':15m' AS opportunity_id, close_time AS created_ms, symbol || ':' || direction || ':trend_pullback:' || market_regime || ':15m@' || CAST(close_time AS VARCHAR) AS id FROM ev)"""


def _signals(spark, d):
    return live.signals(_evaluated(spark, d))


@query(_SIGNALS + " SELECT opportunity_id, created_ms, level, lifecycle_status FROM (SELECT *, lag(level) OVER w AS l0, lag(lifecycle_status) OVER w AS s0 FROM sig WINDOW w AS (PARTITION BY opportunity_id ORDER BY created_ms)) WHERE l0 IS NULL OR l0 <> level OR s0 <> lifecycle_status")
def signal_log_on_change(spark, d):
    return state.changed(_signals(spark, d)).select("opportunity_id", "created_ms", "level", "lifecycle_status")


@query(_SIGNALS + " SELECT opportunity_id, arg_max(symbol, created_ms) AS symbol, arg_max(direction, created_ms) AS direction, arg_max(lifecycle_status, created_ms) AS lifecycle_status, arg_max(score, created_ms) AS current_score, arg_max(level, created_ms) AS current_level, min(created_ms) AS first_detected_ms, max(created_ms) AS last_updated_ms FROM sig GROUP BY opportunity_id")
def opportunities_upsert(spark, d):
    return state.opportunities(_signals(spark, d))


@query(f"WITH {oracle.candles()}, m AS (SELECT max(open_time) AS t FROM candles) SELECT symbol, open_time, CASE WHEN open_time >= t - {10 * H4} THEN close * 2 ELSE close END AS close, CASE WHEN open_time = t THEN 70 ELSE 100 END AS data_quality_score FROM candles, m")
def candles_upsert(spark, d):
    bars = _candles(spark, d).select("symbol", "open_time", "close")
    old = bars.withColumns({"is_closed": F.lit(True), "ingest_seq": F.lit(0)})
    new = bars.crossJoin(F.broadcast(bars.agg(F.max("open_time").alias("last")))).filter(F.col("open_time") >= F.col("last") - 10 * H4)
    new = new.select("symbol", "open_time", (F.col("close") * 2).alias("close"), (F.col("open_time") < F.col("last")).alias("is_closed"), F.lit(1).alias("ingest_seq"))
    return state.candle_quality(state.upserted(old, new, ["symbol", "open_time"], "ingest_seq")).select("symbol", "open_time", "close", "data_quality_score")


@query("SELECT DISTINCT event_type AS symbol, CASE WHEN event_type IN ('view', 'click') THEN 'A' ELSE 'B' END AS pool_type FROM events")
def symbols_upsert(spark, d):
    names = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol")).distinct()
    new = names.withColumns({"pool_type": state.symbol_pool(F.col("symbol"), ("view", "click")), "updated": F.lit(1)})
    old = names.withColumns({"pool_type": F.lit("B"), "updated": F.lit(0)})
    return state.upserted(old, new, ["symbol"], "updated").select("symbol", "pool_type")


@query("SELECT o_orderkey AS notification_id, CASE WHEN o_orderkey % 3 = 0 THEN 'sent' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'queued' END AS status FROM orders")
def notification_status_update(spark, d):
    queued = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("notification_id"), F.lit("queued").alias("status"))
    part = lambda k: queued.filter(F.col("notification_id") % 3 == k).select("notification_id")
    return state.notification_status(queued, part(0), part(1))


@query(_SIGNALS + ", old AS (SELECT opportunity_id, arg_max(level, created_ms) AS latest_level, arg_max(lifecycle_status, created_ms) AS latest_status FROM sig WHERE seq < 100 GROUP BY opportunity_id) SELECT s.id, latest_level, latest_status FROM sig s LEFT JOIN old USING (opportunity_id) WHERE s.seq >= 100")
def latest_stored_signal(spark, d):
    rows = _signals(spark, d)
    return state.with_latest(rows.filter("seq >= 100"), rows.filter("seq < 100")).select("id", "latest_level", "latest_status")


# alerts and texts


@query(_SIGNALS + " SELECT id, symbol, level, score FROM sig WHERE level = 'S' AND symbol NOT IN ('purchase')")
def strong_alerts(spark, d):
    excluded = spark.createDataFrame([("purchase",), *((s,) for s in ALERT_EXCLUDED)], "symbol string")
    return alerts.strong(_signals(spark, d), excluded).select("id", "symbol", "level", "score")


def _price(x: str) -> str:
    return f"coalesce(rtrim(rtrim(printf('%.8f', {x}), '0'), '.'), '')"


_WORDS = """CASE WHEN direction = 'LONG' THEN '做多' ELSE '做空' END AS act, CASE WHEN direction = 'LONG' THEN '上涨' ELSE '下跌' END AS moves, CASE level WHEN 'S' THEN '很强' WHEN 'A' THEN '较强' ELSE '观察' END AS strength,
'数据质量 ' || rtrim(rtrim(printf('%.8f', quality), '0'), '.') || CASE WHEN volume_ratio >= 2 THEN '；成交额放大 ' || printf('%.2f', volume_ratio) || ' 倍' ELSE '' END || CASE WHEN relative_strength > 0 THEN '；相对 BTC 走强 ' || printf('%.2f', relative_strength) || '%' WHEN relative_strength < 0 THEN '；相对 BTC 走弱 ' || printf('%.2f', relative_strength) || '%' ELSE '' END AS why,
'15m 收盘跌破结构位；价格远离入场区超过 1R；数据质量低于 75' AS rules"""


# The wording of messages, written out for comparison.
_ENTRY, _STOP, _TARGETS = f"{_price('entry_low')} || ' - ' || {_price('entry_high')}", _price("stop_loss"), [_price(f"tp{i}") for i in (1, 2, 3)]
_CLOSING = "'这不是自动买入提醒，也不是保证赚钱。它只是提醒你：这里可能有机会，但需要你自己确认仓位和风险。' || chr(10) || '合约波动很大，请控制仓位；看不懂或来不及判断时，宁可错过。'"
_SINGLE_BODY = f"""concat_ws(chr(10), '币种：' || symbol, '方向：关注' || act || '，也就是判断后面可能' || moves || '。', '强度：' || strength || '，系统评分 ' || score || '/100。', '',
CASE WHEN eligible THEN '建议观察价格区间：' || {_ENTRY} || '。价格进入这个区间再考虑，不要追。' ELSE '现在还没有合适的价格区间，只适合先观察，不建议马上行动。' END,
CASE WHEN eligible THEN '风险价：' || {_STOP} || '。如果价格碰到这里，说明这次判断可能错了。' ELSE '风险价：等待确认。' END,
CASE WHEN eligible THEN '第一目标：' || {_TARGETS[0]} || '；第二目标：' || {_TARGETS[1]} || '；第三目标：' || {_TARGETS[2]} || '。' ELSE '目标价：等待确认。' END,
CASE WHEN eligible THEN '如果价格已经超过 ' || {_price('no_chase_price')} || '，就不要追了，容易买在高位或卖在低位。' ELSE '不追价位置：等待确认。' END,
'', '为什么提醒：' || why, '什么时候放弃：' || rules, '', {_CLOSING})"""
_SUMMARY_BLOCK = f"""concat_ws(chr(10), rk || '. ' || symbol || '｜' || strength || '｜' || score || '/100｜关注' || act, '   判断：后面可能' || moves || '。',
CASE WHEN eligible THEN '   观察价格：' || {_ENTRY} || '；风险价：' || {_STOP} || '；目标：' || {_TARGETS[0]} || ' / ' || {_TARGETS[1]} || ' / ' || {_TARGETS[2]} || '。' ELSE '   观察价格：暂未形成合适区间，先观察。' END,
CASE WHEN eligible THEN '   不要追：如果价格已经超过 ' || {_price('no_chase_price')} || '，这次就先放过。' ELSE '   不要追：等待更清楚的位置。' END,
'   原因：' || why, '   放弃条件：' || rules, '')"""


@query(_SIGNALS + f""", w AS (SELECT *, {_WORDS} FROM sig) SELECT id, act || moves || '提醒｜' || score || ' 分｜' || symbol || CASE WHEN eligible THEN '｜风险价 ' || {_STOP} ELSE '｜先观察' END AS subject, {_SINGLE_BODY} AS body FROM w""")
def signal_email(spark, d):
    return alerts.single(_signals(spark, d)).select("id", "subject", "body")


@query(_SIGNALS + f""", w AS (SELECT *, {_WORDS}, row_number() OVER (PARTITION BY created_ms ORDER BY score DESC, symbol) AS rk, count(*) OVER (PARTITION BY created_ms) AS n FROM sig),
b AS (SELECT created_ms, rk, n, act || moves || '强提醒｜' || n || ' 个S级机会｜最高 ' || score || ' 分｜' || symbol AS head, {_SUMMARY_BLOCK} AS block FROM w)
SELECT created_ms, max(CASE WHEN rk = 1 THEN head END) AS subject, '本轮共发现 ' || max(n) || ' 个强提醒机会，已按评分从高到低排列。' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY rk) || chr(10) || {_CLOSING} AS body FROM b GROUP BY created_ms""")
def summary_email(spark, d):
    return alerts.summary(_signals(spark, d).withColumn("ord", F.col("symbol")), "created_ms")


@query("""SELECT o_orderkey, 'From: Radar <radar@example.com>' || chr(13) || chr(10) || 'To: ops@example.com' || chr(13) || chr(10) || 'Subject: =?UTF-8?B?' || base64(encode('提醒 ' || o_orderpriority)) || '?=' || chr(13) || chr(10) || 'MIME-Version: 1.0' || chr(13) || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(13) || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(13) || chr(10) || chr(13) || chr(10) || o_orderstatus || chr(13) || chr(10) || '.' || chr(13) || chr(10) AS message FROM orders""")
def mime_message(spark, d):
    name, email = alerts.sender(F.lit(" Radar "), F.lit("radar@example.com"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", alerts.mime(email, name, F.lit("ops@example.com"), F.concat(F.lit("提醒 "), F.col("o_orderpriority")), F.col("o_orderstatus")).alias("message"))


# read model


@query(_SIGNALS + " SELECT id, symbol, score, created_ms FROM sig ORDER BY created_ms DESC, id LIMIT 20")
def recent_signals(spark, d):
    return readmodel.recent(_signals(spark, d)).select("id", "symbol", "score", "created_ms")


@query(_SIGNALS + " SELECT id, level, score FROM sig WHERE id = (SELECT min(id) FROM sig)")
def signal_by_id(spark, d):
    rows = _signals(spark, d)
    return readmodel.by_id(rows, rows.agg(F.min("id").alias("id"))).select("id", "level", "score")


@query(_SIGNALS + """, n AS (SELECT * FROM sig ORDER BY created_ms DESC, id LIMIT 50), x AS (SELECT symbol, arg_max(level, (created_ms, id)) AS level, arg_max(relative_strength, (created_ms, id)) AS rs0, arg_max(eligible, (created_ms, id)) AS planned, arg_max(score, (created_ms, id)) AS score FROM n GROUP BY symbol)
SELECT symbol, CASE WHEN level IN ('S', 'A') THEN 'C' ELSE 'B' END AS pool, CAST(printf('%.2f', rs0) AS DOUBLE) AS rs, '-' AS volume_ratio, CASE WHEN planned THEN 'normal_vol' ELSE '待确认' END AS atr_state, '未接入' AS funding, score FROM x""")
def radar_rows(spark, d):
    return readmodel.radar(_signals(spark, d))


_DIRTY = """(SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN 'NaN' ELSE CAST(event_id AS VARCHAR) || '.5' END AS score, CASE WHEN event_id % 3 = 0 THEN 'SHORT' ELSE 'up' END AS direction, CASE WHEN event_id % 2 = 0 THEN 'planned' ELSE 'zzz' END AS lifecycle_status, CASE event_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'B' ELSE 'q' END AS level, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'trend' END AS btc_state, event_id FROM events)"""


@query(f"""SELECT id, CASE WHEN event_id % 5 = 4 THEN CAST(score AS DOUBLE) ELSE 0.0 END AS score, CASE WHEN direction = 'SHORT' THEN 'SHORT' ELSE 'LONG' END AS direction, 'trend_pullback' AS signal_type, CASE WHEN lifecycle_status = 'planned' THEN 'planned' ELSE 'detected' END AS lifecycle_status,
CASE WHEN level IN ('S', 'B') THEN level ELSE 'NONE' END AS level, CASE WHEN btc_state = '' THEN 'range' ELSE btc_state END AS btc_state, CASE event_id % 5 WHEN 4 THEN CAST(score AS DOUBLE) WHEN 1 THEN 0.0 END AS entry_low, CASE WHEN event_id % 2 = 0 THEN 'a|b' ELSE '' END AS reasons, CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 0.0 END::DOUBLE AS no_chase_price FROM {_DIRTY}""")
def coerce_signals(spark, d):
    k = F.col("event_id")
    dirty = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").when(k % 5 == 2, "abc").when(k % 5 == 3, "NaN").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        k.cast("string").alias("id"),
        dirty.alias("score"),
        F.when(k % 3 == 0, "SHORT").otherwise("up").alias("direction"),
        F.lit(None).cast("string").alias("signal_type"),
        F.when(k % 2 == 0, "planned").otherwise("zzz").alias("lifecycle_status"),
        F.when(k % 4 == 0, "S").when(k % 4 == 1, "B").otherwise("q").alias("level"),
        F.when(k % 2 == 0, "").otherwise("trend").alias("btc_state"),
        dirty.alias("entry_low"),
        F.when(k % 2 == 0, '["a","b"]').otherwise("{}").alias("reasons"),
        F.when(k % 2 == 0, '{"noChasePrice":1.5}').otherwise("[]").alias("no_chase_rule"),
    )
    return readmodel.coerced(rows)


@query("""SELECT value, CASE WHEN value LIKE '%S%' OR value LIKE '%正常%' OR value LIKE '%planned%' THEN 'green' WHEN value LIKE '%A%' OR value LIKE '%trend%' THEN 'blue' WHEN value LIKE '%B%' OR value LIKE '%观察%' OR value LIKE '%watching%' THEN 'yellow' WHEN value LIKE '%SHORT%' OR value LIKE '%风险%' THEN 'red' ELSE '' END AS color
FROM (SELECT unnest(['S', 'A', 'B', 'SHORT', 'LONG', 'trend', 'planned', 'watching', '风险', '正常', 'x']) AS value)""")
def badge_color(spark, d):
    values = ["S", "A", "B", "SHORT", "LONG", "trend", "planned", "watching", "风险", "正常", "x"]
    return spark.createDataFrame([(v,) for v in values], "value string").select("value", readmodel.badge(F.col("value")).alias("color"))


@query(f"WITH {oracle.candles()} SELECT symbol, open_time, CAST(row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS BIGINT) AS seq, count(*) OVER (PARTITION BY symbol) AS bars FROM candles")
def bar_numbers(spark, d):
    return numbered(_candles(spark, d)).select("symbol", "open_time", F.col("seq").cast("bigint").alias("seq"), "bars")


# rows of the store, and what a run reports


@query(f"WITH {oracle.candles()} SELECT symbol, {_ISO.format('open_time')} AS open_time, {_ISO.format('close_time')} AS close_time, open, high, low, close, is_closed, CASE WHEN is_closed THEN 100 ELSE 70 END AS data_quality_score FROM (SELECT * REPLACE (trades % 5 > 0 AS is_closed) FROM candles)")
def candle_rows(spark, d):
    bars = _candles(spark, d).withColumn("is_closed", F.col("trades") % 5 > 0)
    return state.candle_rows(bars).select("symbol", "open_time", "close_time", "open", "high", "low", "close", "is_closed", "data_quality_score")


_INTERVALS = {"15m": M15, "1h": 3_600_000, "4h": H4}


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {oracle.candles(ms)} SELECT symbol, '{name}' AS interval, open_time, close FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 120)" for name, ms in _INTERVALS.items()))
def multi_interval_scan(spark, d):
    bars = [source.from_events(spark, d, ms).withColumn("interval", F.lit(name)) for name, ms in _INTERVALS.items()]
    return live.scan(bars[0].unionByName(bars[1]).unionByName(bars[2])).select("symbol", "interval", "open_time", "close")


_DIRTY_BARS = f"""{oracle.candles()}, two AS (SELECT *, 0 AS copy FROM candles UNION ALL SELECT *, 1 FROM candles WHERE trades % 7 = 0),
g AS (SELECT *, trades % 11 = 0 AS is_open, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time, copy) AS previous FROM two),
q AS (SELECT symbol, open_time, copy, trades, count_if(is_open) OVER w AS opens, count_if(coalesce(open_time = previous, false)) OVER w AS dups, count_if(coalesce(open_time - previous > 1.5 * {H4}, false)) OVER w AS gaps FROM g WINDOW w AS (PARTITION BY symbol ORDER BY open_time, copy ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_DIRTY_BARS} SELECT symbol, open_time, min(least(100.0, greatest(0.0, 100.0::DOUBLE - 20 * opens - CASE WHEN dups > 0 THEN 25 ELSE 0 END - 10 * gaps - CASE WHEN trades % 3 = 0 THEN 25 ELSE 0 END))) AS quality FROM q GROUP BY ALL")
def data_quality_full(spark, d):
    bars = _candles(spark, d).withColumn("is_closed", F.col("trades") % 11 > 0)
    twice = bars.unionByName(bars.filter("trades % 7 = 0"))
    now = F.col("close_time") + F.when(F.col("trades") % 3 == 0, 3 * H4).otherwise(H4)
    rows = indicators.features(twice, HIST, H4, now)
    return rows.groupBy("symbol", "open_time").agg(F.min("quality").alias("quality"))


_NO_PLAN = ["entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "sl_distance_pct", "sl_atr_ratio"]
_RULE = f"""'{{"direction":"' || direction || '","noChasePrice":"' || {_price('no_chase_price')} || '"}}'"""


@query(_SIGNALS + f""", w AS (SELECT *, {_WORDS} FROM sig) SELECT id, opportunity_id, 'trend_pullback' AS signal_type, lifecycle_status, level, score, CASE WHEN eligible THEN 'pullback_limit' ELSE 'confirmation_wait' END AS entry_mode, {', '.join(f'CASE WHEN eligible THEN {c} END AS {c}' for c in _NO_PLAN)},
CASE WHEN eligible THEN 1.8 END::DOUBLE AS weighted_rr, quality AS data_quality_score, '["' || replace(why, '；', '","') || '"]' AS reasons, '["' || replace(rules, '；', '","') || '"]' AS invalidation_rules, {_RULE} AS no_chase_rule FROM w""")
def signal_rows(spark, d):
    rows = state.signal_rows(_signals(spark, d)).withColumn("weighted_rr", F.round("weighted_rr", 6))
    return rows.select("id", "opportunity_id", "signal_type", "lifecycle_status", "level", "score", "entry_mode", *_NO_PLAN, "weighted_rr", "data_quality_score", "reasons", "invalidation_rules", "no_chase_rule")


@query("""SELECT o_orderkey AS notification_id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 2 THEN 'queued' WHEN o_orderkey % 3 = 0 THEN 'sent' ELSE 'failed' END AS status,
CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN '2023-11-14T22:13:20.000Z' END AS sent_at, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 1 THEN 'refused ' || o_orderkey END AS error_message FROM orders""")
def sent_notifications(spark, d):
    queued = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("notification_id"), F.lit("queued").alias("status"))
    k = F.col("notification_id")
    result = F.when(k % 3 == 0, "sent").when(k % 3 == 1, "failed").otherwise("skipped")
    return state.sent_notifications(queued, queued.filter(k % 4 > 0), result, F.lit(1_700_000_000_000), F.concat(F.lit("refused "), k.cast("string")))


_NEW = """, good AS (SELECT * FROM sig WHERE level IN ('A', 'S')), logged AS (SELECT * FROM (SELECT *, lag(level) OVER w AS l0, lag(lifecycle_status) OVER w AS s0 FROM good WINDOW w AS (PARTITION BY opportunity_id ORDER BY created_ms)) WHERE l0 IS NULL OR l0 <> level OR s0 <> lifecycle_status)"""


def _run(spark, d):
    signals = _signals(spark, d)
    logged = state.changed(signals.filter(F.col("level").isin("A", "S")))
    return signals, logged, alerts.strong(logged, ("purchase",))


_COUNTS = """SELECT (SELECT count(DISTINCT symbol) FROM candles) AS symbols, (SELECT count(*) FROM candles) AS candles, (SELECT count(*) FROM ev) AS generated, (SELECT count(*) FROM good) AS qualified,
(SELECT count(*) FROM logged WHERE level = 'S' AND symbol <> 'purchase') AS strong_alerts, (SELECT count(*) FROM logged) AS persisted_signals, (SELECT count(*) FROM logged WHERE level = 'S' AND symbol <> 'purchase') AS persisted_notifications, CAST(1 AS BIGINT) AS sent_emails, CAST(0 AS BIGINT) AS failed_emails"""
_COUNTERS = ["symbols", "candles", "generated", "qualified", "strong_alerts", "persisted_signals", "persisted_notifications", "sent_emails", "failed_emails"]


@query(_SIGNALS + _NEW + " " + _COUNTS)
def run_counters(spark, d):
    signals, logged, raised = _run(spark, d)
    return state.run_counters(_candles(spark, d), signals, logged, raised, 1, 0)


_COUNTER_JSON = " || ',' || ".join(f"'\"{c}\":' || {c}" for c in _COUNTERS)


@query(_SIGNALS + _NEW + f""", c AS ({_COUNTS}), l AS (SELECT symbol, arg_max(level, open_time) AS level, arg_max(score, open_time) AS score, arg_max(lifecycle_status, open_time) AS status FROM ev GROUP BY symbol)
SELECT '{{"ok":true,' || {_COUNTER_JSON} || '}}' AS counters, (SELECT '[' || string_agg('{{"symbol":"' || symbol || '","level":"' || level || '","score":' || score || ',"status":"' || status || '"}}', ',' ORDER BY symbol) || ']' FROM l) AS signals FROM c""")
def scan_answer(spark, d):
    signals, logged, raised = _run(spark, d)
    counts = state.run_counters(_candles(spark, d), signals, logged, raised, 1, 0)
    return report.answer(counts, readmodel.slim(readmodel.latest_per_symbol(signals)))


@query(_SIGNALS + " SELECT id, symbol, level, score, lifecycle_status AS status FROM sig WHERE lifecycle_status = 'planned'")
def planned_signals(spark, d):
    rows = state.planned(_signals(spark, d))
    return rows.select("id", "symbol", "level", "score", F.col("lifecycle_status").alias("status"))


@query(_SIGNALS + " SELECT symbol, level, score, lifecycle_status AS status FROM sig")
def slim_signals(spark, d):
    return readmodel.slim(_signals(spark, d))


@query(_SIGNALS + " SELECT id, entry_low, tp3 FROM sig WHERE eligible")
def runnable_signals(spark, d):
    return state.runnable(_signals(spark, d)).select("id", "entry_low", "tp3")


@query(_SIGNALS + f""" SELECT id, symbol, level, score, CASE WHEN eligible THEN {_price('entry_low')} || '-' || {_price('entry_high')} ELSE '待确认' END AS entry, CASE WHEN eligible THEN {_price('stop_loss')} || '/' || {_price('tp2')} ELSE '待确认' END AS stop_and_target, CASE WHEN eligible THEN '1:1.8' ELSE '待确认' END AS ratio FROM sig""".replace("待确认", readmodel.WAITING))
def display_strings(spark, d):
    return readmodel.displayed(_signals(spark, d))


@query(_SIGNALS + f" SELECT id, eligible, direction AS rule_direction, {_price('no_chase_price')} AS rule_price FROM sig")
def no_chase_rule(spark, d):
    rows = _signals(spark, d)
    return rows.select("id", "eligible", F.element_at("no_chase_rule", "direction").alias("rule_direction"), F.element_at("no_chase_rule", "noChasePrice").alias("rule_price"))


@query(_SIGNALS.replace("WITH", "WITH RECURSIVE", 1).replace(oracle.evaluated(), oracle.outcomes()) + """, o AS (SELECT opportunity_id, min(created_ms) AS first_detected_ms, max(created_ms) AS last_updated_ms FROM sig GROUP BY opportunity_id)
SELECT s.id, first_detected_ms, last_updated_ms, CAST(CASE WHEN s.level = 'S' THEN 1 ELSE 0 END AS BIGINT) AS notifications, r.final_status, r.final_r FROM sig s JOIN o USING (opportunity_id) LEFT JOIN outc r ON r.symbol = s.symbol AND r.open_time = s.open_time""")
def stored_relations(spark, d):
    signals = _signals(spark, d)
    results = historical.outcomes(_candles(spark, d), HIST, BENCHMARK).join(signals.select("symbol", "open_time", F.col("id").alias("signal_id")), ["symbol", "open_time"])
    notes = signals.filter("level = 'S'").select(F.col("id").alias("signal_id"))
    return state.with_relations(signals.select("id", "opportunity_id"), state.opportunities(signals), notes, results).select("id", "first_detected_ms", "last_updated_ms", "notifications", "final_status", "final_r")


@query("SELECT * FROM (VALUES ('BTCUSDT', 'S', 91), ('ETHUSDT', 'A', 82)) t(symbol, level, score)")
def sample_fallback(spark, d):
    samples = spark.createDataFrame([("BTCUSDT", "S", 91), ("ETHUSDT", "A", 82)], "symbol string, level string, score int")
    return readmodel.with_fallback(samples.filter("score > 100"), samples)


_SUMMARY_EMPTY = "'暂无新机会提醒'"


@query(_SIGNALS + f" SELECT created_ms, CASE WHEN count_if(level = 'S' AND eligible AND score >= 97) = 0 THEN {_SUMMARY_EMPTY} ELSE 'some' END AS subject FROM sig GROUP BY created_ms")
def summary_email_empty(spark, d):
    rows = _signals(spark, d).withColumn("ord", F.col("symbol"))
    out = alerts.summary(rows.filter("level = 'S' AND eligible AND score >= 97"), "created_ms", runs=rows)
    return out.select("created_ms", F.when(F.col("subject") == alerts.SUMMARY["subject_empty"], F.col("subject")).otherwise("some").alias("subject"))


def _library(spark, d):
    return metrics.library_summary(_trades(spark, d), ["polling_minutes"], SYMBOLS)


_PLAIN = {"win_rate": "count_if(final_r > 0) / CAST(count(*) AS DOUBLE) * 100", "entry_fill_rate": "count_if(entry_hit) / CAST(count(*) AS DOUBLE) * 100", "avg_r": "floor(sum(final_r) * 1e6 + 0.5) / 1e6 / count(*)"}


@query(f"""SELECT polling_minutes, total_trades, {', '.join(f'{oracle.r6(c)} AS {c}' for c in _PLAIN)}, profit_factor, max_drawdown, max_losing_streak, 0.0::DOUBLE AS no_chase_rate, 100.0::DOUBLE AS execution_rate
FROM (SELECT polling_minutes, profit_factor, max_drawdown, max_losing_streak FROM ({oracle.summary('polling_minutes')})) JOIN (WITH {oracle.trades()} SELECT polling_minutes, count(*) AS total_trades, {', '.join(f'{x} AS {c}' for c, x in _PLAIN.items())} FROM trades GROUP BY ALL) USING (polling_minutes)""")
def library_summary(spark, d):
    rounded = {c: js.js_round(F.col(c), 1e4).alias(c) for c in ("profit_factor", "max_drawdown")} | {c: R6(c) for c in _PLAIN}
    rows = _library(spark, d)
    return rows.select(*(rounded.get(c, F.col(c)) for c in rows.columns))


@query(f"""WITH {oracle.outcomes()}, chased AS (SELECT symbol, {oracle.js('count_if(no_chase) / CAST(count(*) AS DOUBLE) * 100')} AS no_chase_rate FROM ev GROUP BY symbol), entered AS (SELECT symbol, {oracle.js('count_if(entry_hit) / CAST(count(*) AS DOUBLE) * 100')} AS execution_rate FROM outc GROUP BY symbol)
SELECT symbol, no_chase_rate, coalesce(execution_rate, 0.0) AS execution_rate FROM chased LEFT JOIN entered USING (symbol)""")
def execution_rates(spark, d):
    return metrics.execution_rates(_evaluated(spark, d), historical.outcomes(_candles(spark, d), HIST, BENCHMARK), ["symbol"])


def _report(spark, d, bars, dialect):
    trades = written(historical.trades(bars, dialect, BENCHMARK), "trades")  # read by all sections
    whole = lambda rows, keys, name, suffix="": report.summaries(metrics.summary(rows, keys, symbols=SYMBOLS), keys, name, suffix)
    finest = trades.filter(FIRST)
    sections = [
        report.coverage(metrics.coverage(bars), SYMBOLS),
        whole(trades, ["polling_minutes"], "by_polling", "m"),
        whole(trades.filter(STRONG), ["polling_minutes"], "optimized_by_polling", "m"),
        whole(finest, ["symbol"], "by_symbol"),
        whole(finest, ["symbol", "direction"], "by_symbol_direction"),
        report.samples(report.first_trades(trades, SYMBOLS)),
    ]
    return report.report(sections, {"horizonCandles": report.number(F.lit(dialect.horizon)), "feeRate": report.number(F.lit(dialect.fee)), "slippageRate": report.number(F.lit(dialect.slippage))})


def _json_summary(keys: str, where: str, name: str) -> str:
    key = " || ':' || ".join(f"CAST({k.strip()} AS VARCHAR)" for k in keys.split(",")) + (" || 'm'" if keys == "polling_minutes" else "")
    body = " || ',' || ".join(f"'\"{k}\":' || {_price(f'CAST({c} AS DOUBLE)')}" for k, c in report.MEASURES.items())
    counts = """'{"' || replace(replace(status_counts, ':', '":'), ',', ',"') || '}'"""
    return f"""(SELECT '{{' || coalesce(string_agg('"' || {key} || '":{{' || {body} || ',"statusCounts":' || {counts} || '}}', ',' ORDER BY rank), '') || '}}' FROM ({oracle.summary(keys, where)}))"""


def _json_samples() -> str:
    one = f"""'{{"time":"' || {_ISO.format('open_time')} || '","symbol":"' || symbol || '","direction":"' || direction || '","level":"' || level || '","score":' || score || ',"finalStatus":"' || final_status || '","finalR":' || {_price('final_r')} || '}}'"""
    return f"(SELECT '[' || coalesce(string_agg(x, ',' ORDER BY p, seq), '') || ']' FROM (WITH {oracle.trades()} SELECT {one} AS x, {oracle.PLACE} AS p, seq FROM trades WHERE step = 1 ORDER BY p, seq LIMIT 20))"


def _json_coverage() -> str:
    one = f"""'"' || symbol || '":{{"candles":' || n || ',"first":"' || {_ISO.format('a')} || '","last":"' || {_ISO.format('b')} || '"}}'"""
    return f"(SELECT '{{' || string_agg({one}, ',' ORDER BY {oracle.PLACE}) || '}}' FROM (WITH {oracle.candles()} SELECT symbol, count(*) AS n, min(open_time) AS a, max(open_time) AS b FROM candles GROUP BY symbol))"


@query(f"""SELECT '{{"assumptions":{{"horizonCandles":24,"feeRate":0.0004,"slippageRate":0.0005}},"data_coverage":' || {_json_coverage()} || ',"by_polling":' || {_json_summary('polling_minutes', 'true', '')} || ',"optimized_by_polling":' || {_json_summary('polling_minutes', STRONG, '')}
|| ',"by_symbol":' || {_json_summary('symbol', FIRST, '')} || ',"by_symbol_direction":' || {_json_summary('symbol, direction', FIRST, '')} || ',"sample_trades":' || {_json_samples()} || '}}' AS report""")
def backtest_report(spark, d):
    return _report(spark, d, _candles(spark, d), HIST)


@query(f"""SELECT '["' || (WITH {oracle.trades()} SELECT string_agg(DISTINCT symbol, '","' ORDER BY symbol) FROM trades WHERE step = 1) || '"]' AS symbols, '{{"feeRate":0.0004,"slippageRate":0.0005}}' AS cost_model, CAST(total_trades AS BIGINT) AS total_trades, max_losing_streak
FROM (SELECT trades AS total_trades, max_losing_streak FROM ({oracle.summary('step', FIRST)}))
UNION ALL SELECT '[]', '{{"feeRate":0.0004,"slippageRate":0.0005}}', 0, 0 WHERE NOT EXISTS (WITH {oracle.trades()} SELECT 1 FROM trades WHERE step = 1)""")
def backtest_run(spark, d):
    trades = _trades(spark, d).filter(FIRST)
    run = report.backtest_run(metrics.library_summary(trades, [], SYMBOLS), trades, HIST.fee, HIST.slippage)
    value = lambda name: F.get_json_object("result_summary", f"$.{name}").cast("long")
    return run.select("symbols", "cost_model", value("totalTrades").alias("total_trades"), value("maxLosingStreak").alias("max_losing_streak"))


@query(oracle.summary("polling_minutes", "true", 96, M15))
def summary_by_polling_15m(spark, d):
    bars = source.from_events(spark, d, M15)
    return metrics.summary(written(historical.trades(bars, HIST_15M, BENCHMARK), "trades"), ["polling_minutes"], symbols=SYMBOLS)


# streams


def _ticks(spark, d):
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events*.parquet")
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("price"))


@query(f"WITH {oracle.candles()} SELECT {', '.join(BARS)} FROM candles")
def stream_candles(spark, d):
    path = new_path(spark, "stream-candles")
    bars = streaming.candles(_ticks(spark, d), "4 hours", now=F.lit(1 << 60))
    streaming.started(bars, streaming.upsert_into(f"{path}/table", ["symbol", "open_time"], "trades"), f"{path}/checkpoint", None).awaitTermination()
    return streaming.current(spark, f"{path}/table", bars.schema).select(*BARS)


def stream_signal_log(spark, d):
    path = new_path(spark, "stream-signals")
    bars = streaming.candles(_ticks(spark, d), "4 hours", now=F.lit(1 << 60))
    evaluate = lambda stored: live.signals(historical.evaluated_bars(stored, HIST, BENCHMARK))
    streaming.started(bars, streaming.signal_stream(path, evaluate), f"{path}/checkpoint", None).awaitTermination()
    kept = _signals(spark, d).select("opportunity_id", "created_ms", "level", "lifecycle_status").schema
    return streaming.read_log(spark, path, kept)


QUERIES["stream_signal_log"], SQL["stream_signal_log"] = stream_signal_log, SQL["signal_log_on_change"]


# declared rules


def _breaker_sql(n: int, least: float) -> str:
    return f"WITH {oracle.trades()} SELECT CAST(step AS INTEGER) AS step, symbol, CAST(seq AS BIGINT) AS seq, (count(*) OVER w = {n} AND avg(final_r) OVER w < {least}) AS paused FROM trades WINDOW w AS (PARTITION BY step, symbol, level ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(_breaker_sql(10, -0.3))
def circuit_breaker(spark, d):
    return risk.circuit_breaker(_trades(spark, d)).select("step", "symbol", F.col("seq").cast("bigint").alias("seq"), "paused")


@query(_breaker_sql(3, 0.2))
def circuit_breaker_short(spark, d):
    return risk.circuit_breaker(_trades(spark, d), 3, 0.2).select("step", "symbol", F.col("seq").cast("bigint").alias("seq"), "paused")


@query(f"""WITH {oracle.trades()}, n AS (SELECT *, row_number() OVER (PARTITION BY step, symbol ORDER BY seq) AS i FROM trades),
r AS (SELECT step, symbol, seq, i - coalesce(max(CASE WHEN final_status <> 'hit_sl' THEN i END) OVER (PARTITION BY step, symbol ORDER BY seq), 0) AS stops FROM n)
SELECT CAST(r.step AS INTEGER) AS step, r.symbol, CAST(r.seq AS BIGINT) AS seq, CAST(stops AS BIGINT) AS stops, stops >= 5 AS only_strong, f.atr >= f.close * 0.3 AS alerts_only, f.quality < 75 AS symbol_paused FROM r JOIN feat f ON f.symbol = r.symbol AND f.seq = r.seq""")
def risk_guard(spark, d):
    trades = risk.stops_in_a_row(_trades(spark, d)).select("step", "symbol", "seq", "stops")
    rows = trades.join(_features(spark, d).select("symbol", "seq", "atr", "close", "quality"), ["symbol", "seq"])
    out = risk.guarded(rows, F.col("stops"), F.col("atr") >= F.col("close") * 0.3, F.col("quality"))
    return out.select("step", "symbol", F.col("seq").cast("bigint").alias("seq"), F.col("stops").cast("bigint").alias("stops"), "only_strong", "alerts_only", "symbol_paused")


@query(f"WITH {oracle.features(HIST)} SELECT symbol, open_time, {oracle.js('(max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) - close) / close * 100')} AS max_profit_pct_4, {oracle.js('(close - min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) / close * 100')} AS max_loss_pct_4 FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY open_time)")
def horizon_excursions(spark, d):
    rows = numbered(_candles(spark, d)).select("symbol", "open_time", "seq", "close", "high", "low")
    return risk.excursions(rows, {"4": 4}).select("symbol", "open_time", "max_profit_pct_4", "max_loss_pct_4")


def _ahead(span: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time RANGE BETWEEN 1 FOLLOWING AND {span} FOLLOWING)"


@query(f"WITH {oracle.candles(300_000)} SELECT symbol, open_time, " + ", ".join(f"{oracle.js(f'(max(high) OVER {_ahead(ms)} - close) / close * 100')} AS max_profit_pct_{name}, {oracle.js(f'(close - min(low) OVER {_ahead(ms)}) / close * 100')} AS max_loss_pct_{name}" for name, ms in risk.HORIZONS.items()) + " FROM candles")
def excursions_after(spark, d):
    rows = source.from_events(spark, d, 300_000).select("symbol", "open_time", "close", "high", "low")
    return risk.excursions_after(rows).drop("close", "high", "low")


_METRICS = f"""WITH {oracle.candles()}, m AS (SELECT symbol, open_time, close, quote_volume AS open_interest, CAST((trades * 7 + open_time // {H4}) % 50 - 25 AS DOUBLE) * CAST(0.0001 AS DOUBLE) AS funding_rate FROM candles)"""


def _metrics(spark, d):
    rate = ((F.col("trades") * 7 + F.floor(F.col("open_time") / H4)) % 50 - 25).cast("double") * F.lit(1e-4)
    return _candles(spark, d).select("symbol", "open_time", "close", F.col("quote_volume").alias("open_interest"), rate.alias("funding_rate"))


@query(_METRICS + f" SELECT a.symbol, a.open_time, {oracle.js('count_if(b.funding_rate <= a.funding_rate) / CAST(count(*) AS DOUBLE) * 100')} AS funding_rate_percentile FROM m a JOIN m b ON a.symbol = b.symbol AND b.open_time BETWEEN a.open_time - {10 * 86_400_000} AND a.open_time GROUP BY ALL")
def funding_percentile(spark, d):
    return risk.percentile(_metrics(spark, d), "funding_rate", 10).select("symbol", "open_time", "funding_rate_percentile")


_SPANS = {"4h": H4, "24h": 6 * H4}


@query(_METRICS + " SELECT a.symbol, a.open_time, " + ", ".join(f"{oracle.js(f'(a.{v} - {n}.{v}) / {n}.{v} * 100')} AS {v}_change_{k}" for v, spans in (("open_interest", _SPANS), ("close", {"24h": 0})) for k in spans for n in [f"p{k}"]) + " FROM m a " + " ".join(f"LEFT JOIN m p{k} ON p{k}.symbol = a.symbol AND p{k}.open_time = a.open_time - {ms}" for k, ms in _SPANS.items()))
def market_metrics(spark, d):
    rows = risk.change(risk.change(_metrics(spark, d), "open_interest", _SPANS), "close", {"24h": _SPANS["24h"]})
    return rows.select("symbol", "open_time", "open_interest_change_4h", "open_interest_change_24h", "close_change_24h")


@query(_METRICS + ", c AS (SELECT a.symbol, a.open_time, " + ", ".join(f"{oracle.js(f'(a.close - p{k}.close) / p{k}.close * 100')} AS c{k}" for k in _SPANS) + " FROM m a " + " ".join(f"LEFT JOIN m p{k} ON p{k}.symbol = a.symbol AND p{k}.open_time = a.open_time - {ms}" for k, ms in _SPANS.items()) + ") SELECT a.symbol, a.open_time, " + ", ".join(f"{oracle.r6(f'a.c{k} - b.c{k}')} AS strength_{k}" for k in _SPANS) + " FROM c a JOIN c b ON a.open_time = b.open_time AND b.symbol = 'view'")
def strength_spans(spark, d):
    rows = risk.strength_over(_candles(spark, d).select("symbol", "open_time", "close"), BENCHMARK, _SPANS)
    return rows.select("symbol", "open_time", *(R6(f"strength_{k}") for k in _SPANS))


@query(f"""SELECT f.open_time, f.direction, s.direction AS slow_direction, CASE WHEN f.atr >= f.close * 0.3 THEN 'volatile' WHEN f.direction = 'LONG' AND s.direction = 'LONG' THEN 'bull' WHEN f.direction = 'SHORT' AND s.direction = 'SHORT' THEN 'bear' ELSE 'range' END AS state
FROM (WITH {oracle.features(HIST, 3_600_000)} SELECT * FROM feat WHERE symbol = 'view') f LEFT JOIN (WITH {oracle.features(HIST)} SELECT * FROM feat WHERE symbol = 'view') s ON s.open_time + {H4} = f.open_time // {H4} * {H4}""")
def benchmark_trend(spark, d):
    own = lambda ms: indicators.features(source.from_events(spark, d, ms).filter(F.col("symbol") == BENCHMARK), HIST, ms)
    return risk.benchmark_trend(own(3_600_000), own(H4), H4, 0.3)


@query(_SIGNALS + " SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY symbol, CAST(floor(created_ms / 86400000.0) AS BIGINT) ORDER BY score DESC, created_ms) AS n FROM sig) WHERE n <= 2")
def daily_alert_cap(spark, d):
    return risk.daily_cap(_signals(spark, d), 2).select("id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
