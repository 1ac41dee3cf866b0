"""State machines, lifecycles, breakouts, corrections and keyed streams: against loops and SQL, in one block and in many."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog, catalog_series
from tidemark.dialect import HISTORICAL
from tidemark.operators import asof, breakout, indicators, lifecycle, metrics, orderstat, propagate, risk, state
from tidemark.operators.machine import Machine, replayed
from tidemark.plans import historical, live, oracle
from tidemark.sources import candles as source
from tidemark.streaming import candles, keyed

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
HOUR = catalog_series.HOUR


def walk(spark, seed, n=400, symbols=("view", "a", "b"), missing=0.02, at=0):
    """Bars of an hour along random walks, some of them missing or open."""
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(n):
            new = price + rng.choice([0, 0, 1, -1, 2, -2, 3]) * rng.random()
            if rng.random() > missing:
                high, low = max(price, new) + rng.random(), min(price, new) - rng.random()
                rows.append((s, (at + i) * HOUR, (at + i + 1) * HOUR - 1, price, high, low, new, 1.0, float(rng.randint(1, 9)), 1, rng.random() > 0.01))
            price = new
    return spark.createDataFrame(rows, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, trades int, is_closed boolean")


def test_machine_in_one_block_and_in_many_is_a_loop(spark):
    rng = random.Random(1)
    machine = Machine(("a", "b", "c", "end"), ("x", "y", "z"), {("a", "x"): "b", ("b", "x"): "c", ("b", "y"): "a", ("c", "z"): "a", ("c", "y"): "end"})
    rows = [(k, i, rng.choice(["x", "x", "y", "z", None, "?"])) for k in "pq" for i in sorted(rng.sample(range(-50, 3000), 700))]
    df, want = spark.createDataFrame(rows, "k string, seq long, e string"), []
    for k in "pq":
        now = "a"
        for _, i, e in (r for r in rows if r[0] == k):
            now = machine.rules.get((now, e), now)
            want.append((k, i, now))
    for size in (7, 100, 1 << 20):
        got = replayed(df, machine, ["k"], F.col("e"), size=size)
        assert sorted(tuple(r) for r in got.select("k", "seq", "state").collect()) == sorted(want)
    assert replayed(df.limit(0), machine, ["k"], F.col("e")).count() == 0


ROUGH = catalog_series.ROUGH


def test_lifecycles_do_not_depend_on_blocks_and_agree_with_outcomes(spark):
    bars = walk(spark, 2)
    features = indicators.features(bars, ROUGH, HOUR).cache()
    ev = historical.evaluated_bars(bars, ROUGH, "view").cache()
    signals = ev.filter("eligible")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = lifecycle.signal_states(signals, features, 24, 6)
    assert rows(whole) == rows(lifecycle.signal_states(signals, features, 24, 6, size=5))
    assert rows(lifecycle.opportunity_states(ev)) == rows(lifecycle.opportunity_states(ev, size=9))
    ends = {(r.symbol, r.seq): r.s for r in whole.filter(F.col("at") == F.col("seq") + 24).groupBy("symbol", "seq").agg(F.first("state").alias("s")).collect()}
    outcomes = {(r.symbol, r.seq): r.final_status for r in historical.outcomes(bars, ROUGH, "view").collect()}
    seen = {s: 0 for s in ("hit_sl", "hit_tp1", "hit_tp2", "hit_tp3")}
    assert len(ends) > 100
    for k, s in ends.items():
        if s in seen:
            assert outcomes[k] == s
            seen[s] += 1
        elif s != "invalidated" and k in outcomes:
            assert outcomes[k] == "expired"
    assert seen["hit_sl"] > 0 and seen["hit_tp1"] > 0
    features.unpersist()
    ev.unpersist()


def test_breakouts_are_those_of_a_loop(spark):
    pattern = breakout.Pattern(width=7.0, volume=1.0, within=5, confirm=3)
    features = indicators.features(walk(spark, 3, missing=0.0), ROUGH, HOUR)
    rows = features.select("symbol", "seq", "close", "volume_ratio", "atr", "structure_low", "structure_high").toPandas()
    want = {}
    for s, g in rows.groupby("symbol"):
        g = g.sort_values("seq").reset_index(drop=True)
        for i, r in g.iterrows():
            if not (r.atr > 0 and r.structure_high - r.structure_low <= 7.0 * r.atr):
                continue
            out, at, side = "pending", None, 0
            for j in range(i + 1, len(g)):
                now = int(g.close[j] > r.structure_high) - int(g.close[j] < r.structure_low)
                if side == 0:
                    if now and g.volume_ratio[j] < 1.0:
                        out, at = "drifted", j
                    elif now:
                        side, broke = now, j
                    elif j - i == 5:
                        out, at = "timed_out", j
                elif now == side:
                    out, at = "confirmed_up" if side > 0 else "confirmed_down", j
                elif now or j - broke == 3:
                    out, at = "failed", j
                if at is not None:
                    break
            want[s, i] = (out, at)
    for size in (4, 4096):
        got = {(r.symbol, r.seq): (r.outcome, r.decided) for r in breakout.outcomes(features, pattern, size).collect()}
        assert got == want
    assert {o for o, _ in want.values()} == {*breakout.OUTCOMES, "pending"}
    made = breakout.signals(features, breakout.outcomes(features, pattern), ROUGH).collect()
    assert sum(r.setups for r in made) == sum(o.startswith("confirmed") for o, _ in want.values())
    assert all(r.entry_mode == "breakout_confirm" and (r.tp1 > r.stop_loss) == (r.direction == "LONG") for r in made)


@pytest.mark.parametrize("seed", [1])
def test_corrections_give_what_a_full_run_gives(spark, seed):
    rng = random.Random(seed)
    right = walk(spark, seed, n=700, missing=0.01)
    keys = [(r.symbol, r.open_time) for r in right.select("symbol", "open_time").collect()]
    picked = rng.sample(keys, 4) + [k for k in keys if k[0] == "view"][30:31] + keys[-1:]
    marks = spark.createDataFrame([(*k, i % 2 == 0) for i, k in enumerate(picked)], "symbol string, open_time long, late boolean")
    corrections = right.join(marks.select("symbol", "open_time"), ["symbol", "open_time"], "left_semi")
    known = right.join(marks, ["symbol", "open_time"], "left").filter("late is null or not late")
    known = known.withColumn("high", F.when(F.col("late").isNotNull(), F.col("high") + 5).otherwise(F.col("high"))).select(*right.columns)
    stored = propagate.whole(known, ROUGH, "view")
    bars = propagate.corrected(known, corrections)
    near, changed = propagate.changes(stored, bars, corrections, ROUGH, "view")
    rows = lambda df: sorted(map(repr, df.select(*propagate.RESULT).collect()))
    full = rows(propagate.whole(right, ROUGH, "view"))
    assert rows(propagate.applied(stored, changed)) == full == rows(historical.outcomes(right, ROUGH, "view"))
    assert {r.op for r in changed.select("op").distinct().collect()} == {"-", "+"}
    assert near.count() < right.count()
    assert propagate.changes(stored, bars, corrections.limit(0), ROUGH, "view")[1].count() == 0
    with pytest.raises(ValueError, match="frame"):
        propagate.evaluated(bars, near, HISTORICAL, "view")


def test_keyed_stream_over_batches_restarts_and_late_ticks(spark, tmp_path):
    rng = random.Random(5)
    ticks = [(s, h * 3600 + rng.random() * 3600, rng.random() * 10 + 50) for h in range(240) for s in ("view", "a", "b") for _ in range(rng.choice([0, 1, 2, 5]))]
    ticks = [(s, t, i, p) for i, (s, t, p) in enumerate(ticks)]
    rng.shuffle(ticks)
    # batches by time, but ticks come up to 50 minutes late; some come far too late and are dropped
    batch = lambda t: int(min(5, t // (40 * 3600)))
    parts = [[] for _ in range(6)]
    for r in ticks:
        later = min(5, batch(r[1] + (rng.random() < 0.3) * 3000))
        parts[later].append(r)
    lost = [("a", 3600.0 * 5, 10_001, 9_999.0)]
    parts[4] += lost
    kind = "symbol string, s double, tie long, price double"
    dialect = catalog.NOW.__class__(**(catalog.NOW.__dict__ | {"interval_ms": HOUR}))

    def run():
        read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = read.select("symbol", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "tie", "price")
        one = keyed.signals_to(made, str(tmp_path), dialect, "view", live.signals, "1 hour", None)
        one.awaitTermination()
        keyed.changes_to(spark, str(tmp_path), None).awaitTermination()
        return one

    for part in parts[:3]:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    for part in parts[3:]:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sum(p["numInputRows"] > 0 for p in run().recentProgress) == 3
    df = spark.createDataFrame(ticks, kind)
    bars = source.bucketed(df, F.col("symbol"), F.timestamp_micros((F.col("s") * 1e6).cast("long")), F.col("tie"), F.col("price"), HOUR)
    closed = bars.join(bars.agg((F.max("close_time") - HOUR).alias("until")), F.col("close_time") <= F.col("until")).drop("until")
    want = state.changed(live.signals(historical.evaluated_bars(closed, dialect, "view"))).select("opportunity_id", "created_ms", "level", "lifecycle_status")
    rows = lambda x: sorted(map(tuple, x.collect()))
    got = rows(spark.read.schema(keyed.SIGNAL).parquet(str(tmp_path / "log")))
    assert got == rows(want) and len(got) > 30


def test_bars_take_the_nearest_millisecond_as_the_sql_does(spark, tmp_path):
    hour, rng = HOUR * 1000, random.Random(5)
    # times in microseconds around the ends of hours, before and after 1970, ids against the order of time
    near = (-1501, -1500, -1499, -501, -500, -499, -1, 0, 1, 499, 500, 501, 1500)
    at = [h * hour + step for h in (-3, 0, 1, 2, 40) for step in near]
    rows = pd.DataFrame({"event_id": range(len(at), 0, -1), "ts": pd.to_datetime(at, unit="us"), "user_id": 1, "event_type": "error", "value": [float(rng.randint(1, 900)) for _ in at], "props": ""})
    rows.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    db = duckdb.connect()
    db.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    want = db.execute(f"WITH {oracle.candles(HOUR)} SELECT symbol, open_time, open, high, low, close, quote_volume, trades FROM candles ORDER BY open_time").df()
    names = list(want.columns)
    ticks = catalog_series._batch_ticks(spark, tmp_path)
    whole = [source.from_events(spark, tmp_path, HOUR), candles.candles(ticks, "1 hour")]
    for got in whole:
        pd.testing.assert_frame_equal(got.select(names).orderBy("open_time").toPandas(), want, check_dtype=False)
    parts = keyed.partial_bars(ticks.coalesce(1), HOUR).orderBy("open_time").toPandas()
    assert parts[["open_time", "open", "close", "n"]].values.tolist() == want[["open_time", "open", "close", "trades"]].values.tolist()
    assert catalog_series.queries()["quotes_asof"](spark, tmp_path).orderBy("open_time").toPandas().fillna(-1).values.tolist() == sql("quotes_asof", tmp_path).sort_values("open_time").fillna(-1).values.tolist()


def test_a_task_of_many_batches_of_ticks_passes_one_row_per_bar(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(rng.choice("ab"), rng.randrange(20 * HOUR), i, float(rng.randint(1, 900))) for i in range(3000)]
    ticks = spark.createDataFrame(rows, "symbol string, ms long, tie long, price double").select("symbol", F.timestamp_millis("ms").alias("ts"), "tie", "price").coalesce(1)
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault((r[0], r[1] // HOUR * HOUR), []).append(r)
    want = [(*k, b[0][3], b[-1][3], max(r[3] for r in b), min(r[3] for r in b), sum(r[3] for r in b), len(b)) for k, b in sorted(want.items())]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 70)
    try:
        names = ["symbol", "open_time", "open", "close", "high", "low", "total", "n"]
        assert [tuple(r) for r in keyed.partial_bars(ticks, HOUR).select(*names).orderBy("symbol", "open_time").collect()] == want
        monkeypatch.setattr(keyed, "HELD", 10)  # a task that may not hold all bars passes more rows, with the same sums
        parts = keyed.partial_bars(ticks, HOUR).collect()
        assert len(parts) > len(want) and sum(r.n for r in parts) == len(rows) and sum(r.total for r in parts) == sum(r[3] for r in rows)
    finally:
        spark.conf.set(name, before)


def sql(name, sf):
    db = duckdb.connect()
    db.execute(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    return db.execute((catalog_series.oracle_sql() | catalog.oracle_sql())[name]).df()


#: Columns that can have one value only, by name of the query.
ONE_VALUE = {"rough_planned": {"status"}, "rough_signal_rows": {"signal_type", "invalidation_rules"}, "correction_changes": {"entry_hit"}}


@pytest.mark.parametrize("name", ["rough_evaluations", "rough_quality", "rough_planned", "rough_signal_rows", "rough_displayed", "rough_changes", "rough_outcomes", "signal_lifecycle", "opportunity_lifecycle", "breakout_outcomes", "correction_changes"])
def test_every_branch_occurs(name):
    rows = sql(name, LARGER)
    for c in rows.columns:
        if rows[c].dtype == object or rows[c].dtype == bool:
            assert c in ONE_VALUE.get(name, ()) or rows[c].map(repr).nunique() > 1, c
    if name == "signal_lifecycle":
        assert {*rows.state} == {*lifecycle.SIGNAL.states}
    if name == "opportunity_lifecycle":
        assert {*rows.state} == {*lifecycle.OPPORTUNITY.states}
    if name == "breakout_outcomes":
        assert {*rows.outcome} == {*breakout.OUTCOMES, "pending"}


#: Every kind of query; the driver compares all of them at a larger size.
@pytest.mark.parametrize("name", ["rough_evaluations", "stored_signals", "signal_lifecycle", "opportunity_lifecycle", "breakout_outcomes", "metric_percentiles", "quotes_asof", "trades_together", "hopping_bars", "session_runs", "user_universe", "planned_or_samples"])
def test_same_as_sql(spark, name):
    want = sql(name, SF)
    got = catalog_series.queries()[name](spark, SF).toPandas()[want.columns.tolist()]
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    rows = lambda d: sorted(repr([plain(x) for x in r]) for r in d.astype(object).where(pd.notna(d), None).values.tolist())
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def late_ticks(tmp_path_factory):
    """Events of which one ends nearly every hour of a symbol, less than half a millisecond before the next one, at a price of its own."""
    path, rng, rows = tmp_path_factory.mktemp("late"), random.Random(14), []
    for k, symbol in enumerate(("view", "purchase", "signup", "click", "error")):
        for h in range(170):
            if rng.random() < 0.03:
                continue
            base = 400 + 60 * k + 150 * math.sin(h / (9 + k))
            times = [*rng.sample(range(1000, 3_590_000_000), rng.randint(3, 12)), 3_600_000_000 - rng.randint(1, 499)]
            rows += [(rng.randrange(1 << 40), 1_704_067_200_000_000 + h * 3_600_000_000 + us, symbol, round(base * rng.uniform(0.9, 1.1), 2)) for us in times]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"]).assign(user_id=1, props="")
    events["ts"] = pd.to_datetime(events["ts"], unit="us")
    events.to_parquet(path / "events.parquet", coerce_timestamps="us")
    return str(path)


def plain_rows(d):
    """Rows that compare equal whatever kinds of numbers and lists the two engines give."""
    plain = lambda x: [*map(plain, x)] if isinstance(x, (list, tuple, np.ndarray)) else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(repr(plain(r)) for r in d.astype(object).where(pd.notna(d), None).values.tolist())


@pytest.mark.parametrize("name", ["multi_interval_scan", "opportunity_lifecycle", "planned_or_samples", "planned_or_samples_found", "quotes_asof", "rough_displayed", "rough_evaluations", "rough_mail", "rough_signal_rows", "rough_summary_mail", "signal_badges"])
def test_ticks_at_the_end_of_a_bar_count_as_in_the_sql(spark, late_ticks, name):
    want = sql(name, late_ticks)
    got = (catalog_series.queries() | catalog.queries())[name](spark, late_ticks).toPandas()[want.columns.tolist()]
    assert len(want) > 0 and plain_rows(got) == plain_rows(want)


# order statistics, joins in time, windows, outcomes as a stream


def test_wavelet_counts_are_those_of_a_loop():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (50, 3), (400, 400), (300, 1)):
        ranks = np.unique(rng.integers(0, kinds, n), return_inverse=True)[1].astype(np.int64)
        low = rng.integers(0, n + 1, 200)
        high = low + (rng.random(200) * (n + 1 - low)).astype(np.int64)
        bound = rng.integers(0, ranks.max() + 2, 200)
        want = [int((ranks[a:b] < k).sum()) for a, b, k in zip(low, high, bound, strict=True)]
        assert orderstat.Wavelet(ranks).below(low, high, bound).tolist() == want
    assert orderstat.Wavelet(np.empty(0, np.int64)).below(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)).tolist() == [0]


def test_a_million_rows_of_ninety_days_take_seconds():
    import time

    x, span, began = np.random.default_rng(2).random(1_000_000), 90 * 96, time.time()
    for at in range(0, len(x), span):  # the blocks of one series of 15 minutes
        part = x[max(0, at - span) : at + span]
        ranks = np.unique(part, return_inverse=True)[1].astype(np.int64)
        own = np.arange(min(at, span), len(part))
        out = orderstat.Wavelet(ranks).below(np.maximum(own - span, 0), own + 1, ranks[own] + 1)
        assert (out >= 1).all()
    assert time.time() - began < 60


def test_percentiles_are_those_of_a_loop(spark):
    rng, day = random.Random(8), 86_400_000
    rows = [(s, rng.randrange(60 * 24) * HOUR, rng.choice([None, float("nan"), float("inf"), 1.0, 2.0, rng.random()]), float(rng.randint(0, 5))) for s in "AB" for _ in range(400)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, x double, y double")
    got = orderstat.percentiles(df, ["x", "y"], [2, 9]).collect()
    assert len(got) == len(rows)
    good = lambda v: v is not None and np.isfinite(v)
    for r in got:
        for i, c in ((2, "x"), (3, "y")):
            for d in (2, 9):
                seen = [q[i] for q in rows if q[0] == r.symbol and r.open_time - d * day <= q[1] <= r.open_time and good(q[i])]
                want = sum(v <= r[c] for v in seen) / len(seen) * 100 if good(r[c]) else None
                assert r[f"{c}_percentile_{d}d"] == (None if want is None else pytest.approx(want, abs=1e-4))
    assert orderstat.percentiles(df.limit(0), ["x"], [2]).count() == 0


def test_asof_join_in_one_chunk_and_in_many(spark):
    rng = random.Random(9)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(3000)]), i) for i in range(400)] + [("a", 100, -1), ("a", 100, -1)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(3000)]), i, rng.choice([None, float(i)])) for i in range(150)]
    a = spark.createDataFrame(left, "k string, t long, id long")
    b = spark.createDataFrame(right, "k string, u long, tie long, rate double")

    def want(within):
        for k, t, i in left:
            before = [r for r in right if r[0] == k and k is not None and t is not None and r[1] is not None and r[1] <= t]
            best = max(before, key=lambda r: (r[1], r[2])) if before else None
            yield (k, t, i, *(best[1:] if best and (within is None or t - best[1] <= within) else (None, None, None)))

    for within in (None, 40):
        for chunk in (50, 1 << 40):
            got = asof.asof(a, b, ["k"], "t", "u", "tie", chunk, within)
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want(within)))
    assert asof.asof(a, b.limit(0), ["k"], "t", "u", "tie").filter("u is null").count() == len(left)
    assert asof.asof(a.limit(0), b, ["k"], "t", "u", "tie").count() == 0


def test_overlaps_and_exposure_are_those_of_loops(spark):
    rng = random.Random(10)
    rows = [(i, s, s + rng.choice([0, 3, 40, 300]), rng.choice([1.0, -2.0])) for i in range(150) for s in [rng.randrange(-500, 2000)]]
    df = spark.createDataFrame(rows, "id long, a long, b long, x double")
    pairs = asof.overlapping(df, df, "a", "b", 50)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.l.id, r.r.id) for r in pairs.collect())
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[2] and q[1] <= p[2])
    for chunk in (30, 1 << 40):
        for r in asof.exposure(df, "a", "b", {"n": F.lit(1), "x": F.col("x")}, chunk=chunk).collect():
            active = [q for q in rows if q[1] <= r["at"] <= q[2]]
            assert (r.n_active, r.x_active) == (len(active), sum(q[3] for q in active))


def test_windows_and_unique_ticks_over_several_batches(spark, tmp_path):
    rng = random.Random(11)
    ticks = [("a", h * 60.0 + rng.random() * 50, i, float(rng.randint(1, 9))) for i, h in enumerate(sorted(rng.sample(range(1200), 500)))]
    parts = [[t for t in ticks if t[1] // (240 * 60) == i] for i in range(5)]
    parts[2], late = parts[2][:-5], parts[2][-5:]
    parts[3] += late + late[:2]  # late ticks, some of them twice
    kind = "symbol string, s double, tie long, price double"
    path = lambda name: str(tmp_path / name)
    stamped = lambda df: df.select("symbol", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "tie", "price")
    for part in [*parts, [("end", 1e7, -1, 0.0)]]:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path("in"))
    read = lambda: stamped(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path("in")))
    whole = stamped(spark.createDataFrame(ticks, kind))
    rows = lambda df: sorted(map(repr, df.filter("symbol = 'a'").collect()))
    for name, made, batch in (
        ("hop", lambda: candles.hopping(candles.unique(read(), "4 hours"), late=None), candles.hopping(whole)),
        ("runs", lambda: candles.sessions(candles.unique(read(), "4 hours"), "10 minutes", None), candles.sessions(whole, "10 minutes")),
    ):
        out = made()
        stream = out.writeStream.outputMode("append").format("parquet").option("path", path(name)).option("checkpointLocation", path(f"{name}-checkpoint")).trigger(availableNow=True).start()
        stream.awaitTermination()
        assert sum(p["numInputRows"] > 0 for p in stream.recentProgress) == 6
        assert rows(spark.read.schema(out.schema).parquet(path(name))) == rows(batch.select(*out.columns))


def test_a_stream_started_with_its_interval_runs_until_it_is_stopped(spark, tmp_path):
    import time

    spark.createDataFrame([("a", 1.0, 1, 2.0)], "symbol string, s double, tie long, price double").write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("symbol string, s double, tie long, price double").parquet(str(tmp_path / "in"))
    ticks = read.select("symbol", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "tie", "price")
    bars = candles.candles(ticks, "20 minutes", now=F.lit(0))  # at that time the bar is open
    query = candles.started(bars, candles.upsert_into(str(tmp_path / "table"), ["symbol", "open_time"], "trades"), str(tmp_path / "checkpoint"))
    until = time.time() + 60
    while query.lastProgress is None and time.time() < until:
        time.sleep(0.2)
    assert query.isActive
    query.stop()
    assert [r.is_closed for r in candles.current(spark, str(tmp_path / "table"), bars.schema).collect()] == [False]


def test_summaries_in_one_pass_are_the_single_ones(spark):
    rng = random.Random(12)
    rows = [(st, s, i * 30, rng.choice("SA"), rng.choice([-0.997, 0.0, 0.997]), rng.random() < 0.9, rng.choice(metrics.FINAL_STATUSES), 1.0, 0.5, rng.randint(70, 99)) for st in (1, 2) for s in ("x", "y", None) for i in range(150)]
    df = spark.createDataFrame(rows, "step int, symbol string, seq long, level string, final_r double, entry_hit boolean, final_status string, mfe double, mae double, score int")
    sets = {"all_by_step": (["step"], F.lit(True)), "strong": (["symbol", "level"], F.expr("level = 'S'")), "none": (["level"], F.lit(False))}
    got = metrics.summary_sets(df, sets)
    plain = lambda d, keys: sorted(repr([r[k] for k in keys] + [r[c] for c in ("trades", "win_rate", "entry_fill_rate", "total_r", "median_r", "max_drawdown", "max_losing_streak", "status_counts")]) for r in d.collect())
    assert plain(got.filter("grouping = 'all_by_step'"), ["step"]) == plain(metrics.summary(df, ["step"]), ["step"])
    named = df.fillna("?", ["symbol"])
    assert plain(got.filter("grouping = 'strong'").fillna("?", ["symbol"]), ["symbol", "level"]) == plain(metrics.summary(named.filter("level = 'S'"), ["symbol", "level"]), ["symbol", "level"])
    assert got.filter("grouping = 'none'").count() == 0
    assert max(r.entry_fill_rate for r in got.collect()) < 100


def test_breaker_over_all_symbols_is_that_of_a_loop(spark):
    rng = random.Random(13)
    rows = [(st, s, t * 1000, lv, rng.choice([-1.0, -0.5, 1.0])) for st in (1, 2) for s in "xyz" for t in range(120) for lv in [rng.choice("SA")]]
    df = spark.createDataFrame(rows, "step int, symbol string, open_time long, level string, final_r double")
    want = set()
    for st in (1, 2):
        for lv in "SA":
            own = sorted((r for r in rows if r[0] == st and r[3] == lv), key=lambda r: (r[2], r[1]))
            want |= {(st, r[1], r[2]) for i, r in enumerate(own) if i >= 9 and sum(x[4] for x in own[i - 9 : i + 1]) / 10 < -0.3}
    for chunk in (7000, 1 << 40):
        got = risk.market_breaker(df, chunk=chunk).filter("paused")
        assert {(r.step, r.symbol, r.open_time) for r in got.collect()} == want
    assert len(want) > 20
    guard = risk.guarded(spark.createDataFrame([(4, False, 75.0), (5, True, 74.0)], "n int, wild boolean, q double"), F.col("n"), F.col("wild"), F.col("q")).orderBy("n").collect()
    assert [(r.only_strong, r.alerts_only, r.symbol_paused) for r in guard] == [(False, False, False), (True, True, True)]
