"""Golden numbers, parity with SQL on a small table, and streaming."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.dialect import HISTORICAL, LIVE
from tidemark.functions import js
from tidemark.operators import alerts, indicators, metrics, outcome, plan, risk, schedule, state
from tidemark.operators.ordered import numbered
from tidemark.sources import candles as source
from tidemark.streaming import candles as streaming

SF = "/root/testdata/sf0.001"


def ramp(spark, symbol, start, step, n=40):
    rows = [(symbol, 1_700_000_000_000 + i * 900_000, 1_700_000_899_999 + i * 900_000, c - 1, c + 2, c - 2, c, 100.0 + i, (100.0 + i) * c, 1000, True) for i in range(n) for c in [start + step * i]]
    return spark.createDataFrame(rows, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, trades int, is_closed boolean")


@pytest.mark.parametrize(("dialect", "volume", "score"), [(LIVE, 1.1301389668486672, 91), (HISTORICAL, 1.1234317405566265, 90)])
def test_ramp_of_forty_bars(spark, dialect, volume, score):
    bars = ramp(spark, "SOLUSDT", 100.0, 0.5).unionByName(ramp(spark, "BTCUSDT", 100.0, 0.1))
    rows = indicators.with_benchmark(indicators.features(bars, dialect, 900_000), "BTCUSDT")
    r = plan.evaluated(rows, dialect).filter("symbol = 'SOLUSDT' and seq = 39").first()
    assert (r.atr, r.quality, r.score, r.level, r.lifecycle_status) == (4.0, 100.0, score, "S", "planned")
    assert r.relative_strength == pytest.approx(5.231584821428571, abs=1e-12)
    assert r.volume_ratio == pytest.approx(volume, abs=1e-12)
    assert (r.structure_low, r.structure_high, r.entry_low, r.entry_high, r.stop_loss) == (108.0, 121.5, 118.9, 120.9, 106.8)
    assert (r.tp1, r.tp2, r.tp3, r.sl_atr_ratio, r.no_chase_price) == (132.2, 144.9, 157.6, 3.175, 133.6)


def test_plans(spark):
    df = spark.createDataFrame([("LONG",), ("SHORT",)], "direction string")
    made = plan.build(F.col("direction"), F.lit(100.0), F.lit(2.0), F.lit(96.0), F.lit(106.0), 1e5)
    long, short = df.select("direction", *(c.alias(k) for k, c in made.items())).orderBy("direction").collect()
    assert (long.entry_low, long.entry_high, long.stop_loss, long.tp1, long.tp2, long.tp3, long.no_chase_price) == (99.7, 100.7, 95.4, 104.6, 109.2, 113.8, 105.3)
    assert (short.entry_low, short.entry_high, short.stop_loss, short.tp1, short.tp3, short.no_chase_price) == (99.3, 100.3, 106.6, 93.4, 80.2, 92.7)


def test_first_touch(spark):
    candidate = spark.createDataFrame([("X", 0, "LONG", 100.0, 101.0, 95.0, 106.0, 112.0, 118.0)], "symbol string, seq long, direction string, entry_low double, entry_high double, stop_loss double, tp1 double, tp2 double, tp3 double")
    for high, low, status, r in ((108.0, 94.0, "hit_sl", -0.997), (107.0, 100.0, "hit_tp1", 0.997), (99.0, 97.0, "expired", 0.0)):
        bars = spark.createDataFrame([("X", 1, high, low)], "symbol string, seq long, high double, low double")
        got = outcome.simulated(candidate, bars, 4, LIVE).first()
        assert (got.final_status, got.final_r) == (status, r)


def test_rounding_and_texts(spark):
    row = spark.range(1).select(js.js_round(F.lit(-1.234565), 1e5).alias("a"), js.js_round(F.lit(2.5)).alias("b"), js.number_text(F.lit(113.0)).alias("c"), js.number_text(F.lit(0.0005)).alias("d"), js.number(F.lit("NaN")).alias("e"), js.number(F.lit(None)).alias("f")).first()
    assert tuple(row) == (-1.23456, 3, "113", "0.0005", 0.0, 0.0)


def loop(rows):
    """(step, symbol, seq) taken of rows (step, symbol, seq, duration), in order."""
    taken, free = set(), {}
    for step, symbol, seq, duration in sorted(rows):
        if seq >= free.get((step, symbol), -1):
            taken.add((step, symbol, seq))
            free[step, symbol] = seq + 1 + duration
    return taken


def test_greedy_choice_is_that_of_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(step, s, i, rng.randint(1, 12)) for step in (1, 2) for s in "AB" for i in sorted(rng.sample(range(30_000), 1500))]
    rows += [(4, "dense", i, rng.choice([0, 1, 95, 96])) for i in range(200_000)]  # one unbroken run
    rows += [(1, "edge", i, 96) for i in (4000, 4095, 4096, 4097, 8191, 8192, 12_289)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["step", "symbol", "seq", "duration"]).astype({"step": "int32"}))
    got = {tuple(r) for r in schedule.greedy(df).select("step", "symbol", "seq").collect()}
    assert got == loop(rows)
    assert schedule.greedy(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="longest"):
        schedule.greedy(df, longest=50).count()


def test_percentile_and_excursions_are_those_of_loops(spark):
    import random

    rng = random.Random(8)
    day, hour = 86_400_000, 3_600_000
    rows = [(s, rng.randrange(40 * 24) * hour, rng.choice([None, 1.0, 2.0, rng.random()])) for s in "AB" for _ in range(500)]
    rows = [*{(s, t): (s, t, x, float((x or 0) + 1), float((x or 0) - 1)) for s, t, x in rows}.values()]
    df = spark.createDataFrame(rows, "symbol string, open_time long, close double, high double, low double")
    for s, t, share in [tuple(r) for r in risk.percentile(df, "close", 3).select("symbol", "open_time", "close_percentile").collect()]:
        own = next(x for a, b, x, _, _ in rows if (a, b) == (s, t))
        seen = [x for a, b, x, _, _ in rows if a == s and t - 3 * day <= b <= t and x is not None]
        assert share == (pytest.approx(sum(own is not None and x <= own for x in seen) / len(seen) * 100, abs=1e-4) if seen else None)
    got = {(r.symbol, r.open_time): r["max_profit_pct_4h"] for r in risk.excursions_after(df).collect()}
    for s, t, x, _, _ in rows:
        ahead = [h for a, b, _, h, _ in rows if a == s and t < b <= t + 4 * hour]
        assert got[s, t] == (pytest.approx((max(ahead) - x) / x * 100, abs=1e-3) if ahead and x else None)


def test_excursions_of_a_price_of_zero_are_those_of_the_sql(spark):
    import math

    minute = 60_000
    rows = [("A", 0, 0.0, 0.0, 0.0), ("A", 5 * minute, 0.0, 3.0, 0.0), ("A", 40 * minute, 2.0, 2.0, 0.5), ("A", 45 * minute, 0.0, 0.0, -1.0)]
    got = risk.excursions_after(spark.createDataFrame(rows, "symbol string, open_time long, close double, high double, low double")).orderBy("open_time").collect()
    assert [r["max_profit_pct_10m"] for r in got] == [float("inf"), None, -100.0, None]
    assert math.isnan(got[0]["max_loss_pct_10m"]) and got[2]["max_loss_pct_10m"] == 150.0
    assert got[1]["max_profit_pct_1h"] == got[1]["max_loss_pct_1h"] == float("inf")
    assert got[3]["max_profit_pct_4h"] is None and got[3]["max_loss_pct_4h"] is None


def test_row_before_and_stops_do_not_depend_on_chunks(spark):
    rows = [("a", i * 10, "S" if i % 7 else "A", "planned") for i in range(300)]
    df = spark.createDataFrame(rows, "opportunity_id string, created_ms long, level string, lifecycle_status string")
    logs = [sorted(r.created_ms for r in state.changed(df, chunk=n).collect()) for n in (50, 1 << 40)]
    assert logs[0] == logs[1] == [i * 10 for i in range(300) if i % 7 in (0, 1)]
    trades = spark.createDataFrame([(1, "X", i * 40, "hit_tp1" if i in (3, 250) else "hit_sl") for i in range(400)], "step int, symbol string, seq long, final_status string")
    got = {r.seq // 40: r.stops for r in risk.stops_in_a_row(trades).collect()}
    assert all(got[i] == (i + 1 if i < 3 else i - 3 if i < 250 else i - 250) for i in range(400))


def test_library_summary(spark):
    df = spark.createDataFrame([(1, "ETHUSDT", 1, 1.0, True, "hit_tp1"), (1, "ETHUSDT", 2, -1.0, True, "hit_sl")], "step int, symbol string, seq long, final_r double, entry_hit boolean, final_status string")
    df = df.withColumns({"mfe": F.lit(0.0), "mae": F.lit(0.0), "score": F.lit(80)})
    r = metrics.library_summary(df, []).first()
    assert (r.total_trades, r.win_rate, r.max_losing_streak, r.avg_r, r.profit_factor, r.no_chase_rate, r.execution_rate) == (2, 50.0, 1, 0.0, 1.0, 0.0, 100.0)


def test_trades_are_appended_in_configured_order(spark):
    rows = [(1, s, i, r) for s, r in (("DOGEUSDT", -1.0), ("ETHUSDT", 1.0), ("zzz", -1.0)) for i in range(2)]
    df = spark.createDataFrame(rows, "step int, symbol string, seq long, final_r double").withColumn("g", F.lit("all"))
    assert metrics.losing_streak(df, ["g"]).first().max_losing_streak == 4  # ETHUSDT comes before DOGEUSDT, the unknown symbol last
    assert metrics.losing_streak(df, ["g"], ("DOGEUSDT", "ETHUSDT", "zzz")).first().max_losing_streak == 2


def test_quality_of_unclean_series(spark):
    bars = ramp(spark, "X", 100.0, 0.5, 5).withColumn("is_closed", F.col("open_time") != 1_700_000_000_000 + 4 * 900_000)
    bars = bars.unionByName(bars.filter("open_time = 1700000000000 + 900000")).filter("open_time <> 1700000000000 + 2 * 900000")
    now = F.lit(1_700_000_899_999 + 4 * 900_000 + 2 * 900_000 + 1)
    rows = indicators.features(bars, HISTORICAL, 900_000, now).orderBy("seq").collect()
    # all stale at that time (25); then a duplicate (25), a gap (10) and an open bar (20)
    assert [r.quality for r in rows] == [75.0, 75.0, 50.0, 40.0, 20.0]


def test_cache(spark, tmp_path):
    bars = ramp(spark, "X", 100.0, 0.5, 120).withColumns({"interval": F.lit("15m"), "taker_buy_volume": F.lit(0.0), "taker_buy_quote_volume": F.lit(0.0)})
    source.write_cache(bars, str(tmp_path / "good"))
    source.write_cache(bars.limit(50), str(tmp_path / "short"))
    assert source.read_cache(spark, str(tmp_path / "good")).select(*bars.columns).exceptAll(bars).isEmpty()
    assert source.read_cache(spark, str(tmp_path / "short")).isEmpty()
    assert source.read_cache(spark, str(tmp_path / "short"), bars).count() == 120


def test_drawdown_and_streak_are_those_of_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(1, s, i * 50, rng.choice([-0.997, 0.0, 0.997, 1.997])) for s in "AB" for i in range(300)]
    df = spark.createDataFrame(rows, "step int, symbol string, seq long, final_r double").withColumn("g", F.lit("all"))
    equity = peak = drawdown = streak = longest = 0
    for _, _, _, r in rows:
        equity += r
        peak = max(peak, equity)
        drawdown = max(drawdown, peak - equity)
        streak = streak + 1 if r < 0 else 0
        longest = max(longest, streak)
    assert metrics.max_drawdown(df, ["g"]).first().max_drawdown == pytest.approx(drawdown, abs=1e-4)
    assert metrics.losing_streak(df, ["g"]).first().max_losing_streak == longest


def test_numbers_do_not_depend_on_chunks(spark):
    bars = ramp(spark, "X", 100.0, 0.5, 300)
    a = numbered(bars, chunk=10 * 900_000).select("open_time", "seq", "bars").orderBy("seq").collect()
    assert [r.seq for r in a] == list(range(300)) and {r.bars for r in a} == {300}


def test_summary_mail_order(spark):
    rows = [("r", i, s, "LONG", lv, p, 102.8, 103.7, 98.4, 108.2, 113.0, 117.8, 116.2, [], ["x"]) for i, (s, lv, p) in enumerate([("SOLUSDT", "S", 84), ("ETHUSDT", "S", 89), ("BNBUSDT", "S", 88)])]
    df = spark.createDataFrame(rows, "run_id string, ord int, symbol string, direction string, level string, score int, entry_low double, entry_high double, stop_loss double, tp1 double, tp2 double, tp3 double, no_chase_price double, reasons array<string>, invalidation_rules array<string>")
    body = alerts.summary(df).first().body
    assert body.index("1. ETHUSDT") < body.index("2. BNBUSDT") < body.index("3. SOLUSDT") and "108.2 / 113 / 117.8" in body


#: Every kind of query; the driver compares all of them at a larger size.
COMPARED = """candles_from_events normalize_klines atr14 data_quality_full data_quality_bounded evaluate_bars_hist evaluate_latest_live funding_health outcomes trades_greedy
summary_by_polling losing_streak library_summary backtest_run sample_trades signal_log_on_change candle_rows multi_interval_scan signal_rows sent_notifications run_counters display_strings
stored_relations radar_rows coerce_signals badge_color stream_candles circuit_breaker risk_guard funding_percentile market_metrics benchmark_trend""".split()


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "orders", "customer", "lineitem"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()[want.columns.tolist()]
    rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_streams_over_several_batches(spark, tmp_path):
    ticks = spark.createDataFrame([("X", i * 60, i, 100.0 + i % 7) for i in range(90)], "symbol string, s long, tie long, price double").select("symbol", F.timestamp_seconds("s").alias("ts"), "tie", "price")
    for i in range(3):
        ticks.filter(F.col("tie").between(i * 30, i * 30 + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bars = streaming.candles(read, "20 minutes", "0 minutes", now=F.lit(1 << 60))
    keep = streaming.upsert_into(str(tmp_path / "table"), ["symbol", "open_time"], "trades")
    streaming.started(bars, keep, str(tmp_path / "checkpoint"), None).awaitTermination()
    got = streaming.current(spark, str(tmp_path / "table"), bars.schema)
    want = source.bucketed(ticks, F.col("symbol"), F.col("ts"), F.col("tie"), F.col("price"), 20 * 60_000)
    assert got.drop("bucket").select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count() == 5
    first = got.limit(1).drop("bucket").withColumn("trades", F.lit(99))
    keep(first, 7)
    keep(first, 7)  # a batch that is run again takes effect once
    now = streaming.current(spark, str(tmp_path / "table"), bars.schema)
    assert now.count() == 5 and now.filter("trades = 99").count() == 1


def test_logged_changes(spark, tmp_path):
    log = streaming.log_changes(str(tmp_path))
    kind = "opportunity_id string, created_ms long, level string, lifecycle_status string"
    log(spark.createDataFrame([("a", 1, "S", "planned"), ("a", 2, "S", "planned"), ("a", 3, "A", "planned")], kind), 0)
    for _ in range(2):
        log(spark.createDataFrame([("a", 4, "A", "planned"), ("b", 5, "S", "planned")], kind), 1)
    log(spark.createDataFrame([("a", 6, "S", "planned")], kind), 2)
    rows = streaming.read_log(spark, str(tmp_path), spark.createDataFrame([], kind).schema)
    assert sorted((r.opportunity_id, r.created_ms) for r in rows.collect()) == [("a", 1), ("a", 3), ("a", 6), ("b", 5)]
