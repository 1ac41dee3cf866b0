"""The queries of the catalogue as SQL, for comparison: chains of common table expressions."""

from __future__ import annotations

from tidemark.dialect import HISTORICAL, LIVE, Dialect

H4 = 4 * 3_600_000
WEEK = 7 * 24 * 3_600_000


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def js(x: str, scale: str = "1e4") -> str:
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def candles(interval: int = H4) -> str:
    return f"""c0 AS (SELECT event_type AS symbol, CAST(floor(epoch_ms(ts) / {interval}.0) * {interval} AS BIGINT) AS open_time, epoch_ms(ts) AS ts_ms, event_id AS tie, value AS price FROM events WHERE value IS NOT NULL),
candles AS (SELECT symbol, open_time, open_time + {interval} - 1 AS close_time, arg_min(price, (ts_ms, tie)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ms, tie)) AS close,
  CAST(count(*) AS DOUBLE) AS volume, {r6('sum(price)')} AS quote_volume, CAST(count(*) AS INTEGER) AS trades, true AS is_closed FROM c0 GROUP BY ALL)"""


def rough(interval: int) -> str:
    """Unclean bars: one symbol's price is coarse, so that it stands still for long; the bars of every 41st hour are open; hours without events are gaps."""
    text = candles(interval).replace("value AS price", "CASE WHEN event_type = 'error' THEN floor(value / 200) * 200 ELSE value END AS price")
    return text.replace("true AS is_closed", f"open_time // {interval} % 41 <> 3 AS is_closed")


def features(d: Dialect, interval: int = H4, bars: str | None = None) -> str:
    """``bars`` are other candles than those of the events, with open ones among them."""
    frame = f"rows between {d.quality_bars - 1} preceding and current row" if d.quality_bars else "rows between unbounded preceding and current row"
    pairs = f"rows between {d.quality_bars - 2} preceding and current row" if d.quality_bars else frame
    opened = f" - 20 * coalesce(sum(CASE WHEN is_closed THEN 0 ELSE 1 END) OVER (w {frame}), 0)" if bars else ""
    return (bars or candles(interval)) + f""",
f0 AS (SELECT *, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY symbol) AS bars, lag(close) OVER w AS previous, lag(open_time) OVER w AS previous_time, lag(close, 9) OVER w AS close9,
  first(close) OVER (w ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS close15, min(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS structure_low, max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS structure_high,
  avg(quote_volume) OVER (w ROWS BETWEEN {d.volume_bars} PRECEDING AND 1 PRECEDING) AS base FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
f1 AS (SELECT *, CASE WHEN previous IS NOT NULL THEN greatest(high - low, abs(high - previous), abs(low - previous)) END AS true_range,
  CASE WHEN open_time - previous_time > 1.5 * {interval} THEN 1 ELSE 0 END AS gap FROM f0),
feat AS (SELECT *, coalesce(avg(true_range) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0.0) AS atr,
  CASE WHEN coalesce(base, 0) = 0 THEN CAST({d.volume_default} AS DOUBLE) ELSE quote_volume / base END AS volume_ratio,
  CASE WHEN close15 = 0 THEN 0.0 ELSE (close - close15) / close15 * 100 END AS move,
  CASE WHEN close >= close9 THEN 'LONG' ELSE 'SHORT' END AS direction,
  least(100.0, greatest(0.0, 100.0{opened} - 10 * coalesce(sum(gap) OVER (w {pairs if d.quality_bars else frame}), 0))) AS quality
  FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""


SCORE = """least(100.0, greatest(0.0, least(10.0, greatest(0.0, quality / 10)) + (CASE WHEN aligned THEN 10.0 ELSE 4.0 END) + 10.0 + 8.0 + 8.0 + 14.0
  + least(1.0, greatest(0.0, volume_ratio / 2)) * 8 + 5.0 + {funding} + least(6.0, greatest(0.0, abs(relative_strength))) + 5.0 + 5.0))"""


def scored(d: Dialect, source: str) -> str:
    """From rows with relative_strength in ``source`` to ``ev``."""
    s = "1e5" if d.plan_scale == 1e5 else "1e4"
    long = "direction = 'LONG'"
    stop = f"CASE WHEN {long} THEN structure_low - atr * CAST(0.3 AS DOUBLE) ELSE structure_high + atr * CAST(0.3 AS DOUBLE) END"
    return f""",
s0 AS (SELECT *, CASE WHEN {long} THEN relative_strength >= -2 ELSE relative_strength <= 2 END AS aligned, {stop} AS stop0,
  close - atr * (CASE WHEN {long} THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END) AS low0, close + atr * (CASE WHEN {long} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END) AS high0 FROM {source}),
s1 AS (SELECT *, CASE WHEN {long} THEN close - stop0 ELSE stop0 - close END AS risk0, CAST(floor({SCORE.format(funding=d.funding_null)} + 0.5) AS INTEGER) AS score FROM s0),
s2 AS (SELECT *, {js('low0', s)} AS entry_low, {js('high0', s)} AS entry_high, {js('stop0', s)} AS stop_loss,
  {js(f'CASE WHEN {long} THEN close + risk0 ELSE close - risk0 END', s)} AS tp1, {js(f'CASE WHEN {long} THEN close + risk0 * 2 ELSE close - risk0 * 2 END', s)} AS tp2, {js(f'CASE WHEN {long} THEN close + risk0 * 3 ELSE close - risk0 * 3 END', s)} AS tp3,
  {js('abs(CASE WHEN close = 0 THEN 0.0 ELSE (close - stop0) / close END) * 100', s)} AS sl_distance_pct, {js('CASE WHEN atr = 0 THEN 0.0 ELSE abs(close - stop0) / atr END', s)} AS sl_atr_ratio,
  {js(f'CASE WHEN {long} THEN high0 + risk0 ELSE low0 - risk0 END', s)} AS no_chase_price,
  CASE WHEN score >= 88 THEN 'S' WHEN score >= 78 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'NONE' END AS level FROM s1),
s3 AS (SELECT *, CASE WHEN {long} THEN entry_high - stop_loss ELSE stop_loss - entry_low END AS risk1 FROM s2),
s4 AS (SELECT *, (risk1 <= 0) OR (CASE WHEN {long} THEN close > entry_high + risk1 ELSE close < entry_low - risk1 END) AS no_chase FROM s3),
s5 AS (SELECT *, level IN ('A', 'S') AND quality >= 90 AND NOT no_chase AS eligible FROM s4),
ev AS (SELECT *, CASE WHEN eligible THEN 'planned' WHEN score >= 65 THEN 'watching' ELSE 'detected' END AS lifecycle_status, CASE WHEN relative_strength >= 0 THEN 'weak_bull' ELSE 'range' END AS btc_state,
  CASE WHEN volume_ratio >= 2 THEN 'expansion' ELSE 'trend' END AS market_regime FROM s5)"""


def evaluated(d: Dialect = HISTORICAL, interval: int = H4, bars: str | None = None) -> str:
    return features(d, interval, bars) + f""",
j AS (SELECT a.*, a.move - b.move AS relative_strength, b.seq AS benchmark_seq FROM feat a JOIN feat b ON a.open_time = b.open_time AND b.symbol = 'view'
  WHERE a.symbol <> 'view' AND a.seq >= {d.least_seq} AND b.seq >= {d.least_seq})""" + scored(d, "j")


def latest(d: Dialect = LIVE) -> str:
    return features(d) + f""",
l AS (SELECT * FROM feat WHERE seq = bars - 1 AND bars > {d.least_seq}),
j AS (SELECT a.*, a.move - b.move AS relative_strength FROM l a, l b WHERE b.symbol = 'view' AND a.symbol <> 'view')""" + scored(d, "j")


def outcomes(d: Dialect = HISTORICAL, horizon: int = 24, interval: int = H4, bars: str | None = None) -> str:
    up = lambda col: f"(CASE WHEN k.direction = 'LONG' THEN b.high >= k.{col} ELSE b.low <= k.{col} END)"
    sl = "(CASE WHEN k.direction = 'LONG' THEN b.low <= k.stop_loss ELSE b.high >= k.stop_loss END)"
    return evaluated(d, interval, bars) + f""",
k AS (SELECT * FROM ev WHERE eligible AND seq < bars - {horizon}),
e AS (SELECT k.symbol, k.seq, min(b.seq) AS entry FROM k JOIN feat b ON b.symbol = k.symbol AND b.seq > k.seq AND b.seq <= k.seq + {horizon} AND b.low <= k.entry_high AND b.high >= k.entry_low GROUP BY ALL),
x AS (SELECT k.symbol, k.seq, min(b.seq) AS hit FROM k JOIN e USING (symbol, seq) JOIN feat b ON b.symbol = k.symbol AND b.seq >= e.entry AND b.seq <= k.seq + {horizon} AND ({sl} OR {up('tp1')} OR {up('tp2')} OR {up('tp3')}) GROUP BY ALL),
m AS (SELECT k.symbol, k.seq, greatest(0.0, max(CASE WHEN k.direction = 'LONG' THEN b.high - k.entry_high ELSE k.entry_low - b.low END) / abs(max(k.entry_high) - max(k.stop_loss))) AS mfe,
  greatest(0.0, max(CASE WHEN k.direction = 'LONG' THEN k.entry_high - b.low ELSE b.high - k.entry_low END) / abs(max(k.entry_high) - max(k.stop_loss))) AS mae
  FROM k JOIN e USING (symbol, seq) LEFT JOIN x USING (symbol, seq) JOIN feat b ON b.symbol = k.symbol AND b.seq >= e.entry AND b.seq <= coalesce(x.hit, k.seq + {horizon}) GROUP BY k.symbol, k.seq),
o0 AS (SELECT k.symbol, k.seq, k.open_time, k.direction, k.level, k.score, k.entry_low, k.entry_high, k.stop_loss, k.tp1, k.tp2, k.tp3, e.entry IS NOT NULL AS entry_hit,
  CASE WHEN x.hit IS NULL THEN 'expired' WHEN {sl} THEN 'hit_sl' WHEN {up('tp3')} THEN 'hit_tp3' WHEN {up('tp2')} THEN 'hit_tp2' ELSE 'hit_tp1' END AS final_status,
  {js('coalesce(m.mfe, 0.0)')} AS mfe, {js('coalesce(m.mae, 0.0)')} AS mae, CAST(coalesce(x.hit - k.seq, {horizon}) AS BIGINT) AS duration
  FROM k LEFT JOIN e USING (symbol, seq) LEFT JOIN x USING (symbol, seq) LEFT JOIN m USING (symbol, seq) LEFT JOIN feat b ON b.symbol = k.symbol AND b.seq = x.hit),
o1 AS (SELECT *, CAST(CASE final_status WHEN 'hit_sl' THEN -1 WHEN 'hit_tp1' THEN 1 WHEN 'hit_tp2' THEN 2 WHEN 'hit_tp3' THEN 3 ELSE 0 END AS DOUBLE) AS r0 FROM o0),
outc AS (SELECT * EXCLUDE (r0), {js(f'r0 - sign(r0) * (CAST({d.fee} AS DOUBLE) + CAST({d.slippage} AS DOUBLE)) * 2')} AS final_r FROM o1)"""


def trades(d: Dialect = HISTORICAL, horizon: int = 24, interval: int = H4, bars: str | None = None) -> str:
    return outcomes(d, horizon, interval, bars).replace("c0 AS", "RECURSIVE c0 AS", 1) + f""",
st AS (SELECT o.*, s.step FROM outc o, (SELECT unnest([1, 2, 4]) AS step) s WHERE (seq - {d.least_seq}) % s.step = 0),
pick AS (SELECT step, symbol, min(seq) AS seq FROM st GROUP BY ALL
  UNION ALL SELECT p.step, p.symbol, (SELECT min(n.seq) FROM st n WHERE n.step = p.step AND n.symbol = p.symbol AND n.seq >= p.seq + 1 + c.duration) AS seq
  FROM pick p JOIN st c ON c.step = p.step AND c.symbol = p.symbol AND c.seq = p.seq WHERE p.seq IS NOT NULL),
trades AS (SELECT st.*, CAST(st.step * {interval // 60_000} AS INTEGER) AS polling_minutes FROM st JOIN (SELECT DISTINCT * FROM pick WHERE seq IS NOT NULL) USING (step, symbol, seq))"""


#: The configured order of the symbols, in which a backtest appends their trades.
SYMBOLS = ("view", "purchase", "signup", "click", "error")
PLACE = f"list_position([{', '.join(repr(s) for s in SYMBOLS)}], symbol)"


def summary(keys: str, where: str = "true", horizon: int = 24, interval: int = H4, d: Dialect = HISTORICAL, bars: str | None = None) -> str:
    k = keys
    over = f"PARTITION BY {k} ORDER BY step, {PLACE}, seq"
    gains, losses = "sum(CASE WHEN final_r > 0 THEN final_r ELSE 0.0 END)", "abs(sum(CASE WHEN final_r < 0 THEN final_r ELSE 0.0 END))"
    mean = lambda c: js(f"floor(sum({c}) * 1e6 + 0.5) / 1e6 / count(*)")
    return f"""WITH {trades(d, horizon, interval, bars)},
t AS (SELECT * FROM trades WHERE {where}),
base AS (SELECT {k}, count(*) AS trades, {js('count_if(final_r > 0) / CAST(count(*) AS DOUBLE) * 100')} AS win_rate, {js('count_if(entry_hit) / CAST(count(*) AS DOUBLE) * 100')} AS entry_fill_rate,
  {mean('final_r')} AS avg_r, {js('sum(final_r)')} AS total_r, {js('median(final_r)')} AS median_r, {js(f'CASE WHEN {losses} = 0 THEN {gains} ELSE {gains} / {losses} END')} AS profit_factor,
  {mean('mfe')} AS avg_mfe, {mean('mae')} AS avg_mae, {mean('score')} AS avg_score FROM t GROUP BY {k}),
eq AS (SELECT *, sum(final_r) OVER ({over} ROWS UNBOUNDED PRECEDING) AS equity, sum(CASE WHEN final_r < 0 THEN 0 ELSE 1 END) OVER ({over} ROWS UNBOUNDED PRECEDING) AS run FROM t),
pk AS (SELECT *, greatest(0.0, max(equity) OVER ({over} ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
dd AS (SELECT {k}, {js('max(peak - equity)')} AS max_drawdown FROM pk GROUP BY {k}),
sk AS (SELECT {k}, max(n) AS max_losing_streak FROM (SELECT {k}, run, count_if(final_r < 0) AS n FROM pk GROUP BY {k}, run) GROUP BY {k}),
hs AS (SELECT {k}, string_agg(x, ',' ORDER BY x) AS status_counts FROM (SELECT {k}, final_status || ':' || CAST(count(*) AS VARCHAR) AS x FROM t GROUP BY {k}, final_status) GROUP BY {k})
SELECT base.*, max_drawdown, CAST(max_losing_streak AS BIGINT) AS max_losing_streak, status_counts, CAST(row_number() OVER (ORDER BY total_r DESC, {k}) AS INTEGER) AS rank
FROM base JOIN dd USING ({k}) JOIN sk USING ({k}) JOIN hs USING ({k})"""
