"""Alerts: which signals raise one, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import ALERT_EXCLUDED
from tidemark.functions.js import number_text


def strong(signals: DataFrame, excluded: tuple[str, ...] | DataFrame = ALERT_EXCLUDED) -> DataFrame:
    """Signals of the top level whose symbol isn't excluded; exclusions may be a table of symbols."""
    top = signals.filter(F.col("level") == "S")
    if isinstance(excluded, DataFrame):
        return top.join(excluded.select("symbol"), "symbol", "left_anti")
    return top.filter(~F.col("symbol").isin(*excluded))


# The wording of messages.
SIDE = {"LONG": ("做多", "上涨"), "SHORT": ("做空", "下跌")}
STRENGTH = {"S": "很强", "A": "较强"}
STRENGTH_ELSE, NO_REASON, JOINER = "观察", "暂无更多原因。", "；"
CLOSING = (
    "这不是自动买入提醒，也不是保证赚钱。它只是提醒你：这里可能有机会，但需要你自己确认仓位和风险。",
    "合约波动很大，请控制仓位；看不懂或来不及判断时，宁可错过。",
)
SINGLE = {
    "subject": "{act}{move}提醒｜{score} 分｜{symbol}｜风险价 {stop_loss}",
    "subject_without": "{act}{move}提醒｜{score} 分｜{symbol}｜先观察",
    "lines": (
        ("币种：{symbol}", None),
        ("方向：关注{act}，也就是判断后面可能{move}。", None),
        ("强度：{strength}，系统评分 {score}/100。", None),
        ("", None),
        ("建议观察价格区间：{entry_low} - {entry_high}。价格进入这个区间再考虑，不要追。", "现在还没有合适的价格区间，只适合先观察，不建议马上行动。"),
        ("风险价：{stop_loss}。如果价格碰到这里，说明这次判断可能错了。", "风险价：等待确认。"),
        ("第一目标：{tp1}；第二目标：{tp2}；第三目标：{tp3}。", "目标价：等待确认。"),
        ("如果价格已经超过 {no_chase_price}，就不要追了，容易买在高位或卖在低位。", "不追价位置：等待确认。"),
        ("", None),
        ("为什么提醒：{why}", None),
        ("什么时候放弃：{rules}", None),
        ("", None),
    ),
}
SUMMARY = {
    "subject": "{act}{move}强提醒｜{n} 个S级机会｜最高 {score} 分｜{symbol}",
    "subject_empty": "暂无新机会提醒",
    "head": "本轮共发现 {n} 个强提醒机会，已按评分从高到低排列。",
    "lines": (
        ("{rank}. {symbol}｜{strength}｜{score}/100｜关注{act}", None),
        ("   判断：后面可能{move}。", None),
        ("   观察价格：{entry_low} - {entry_high}；风险价：{stop_loss}；目标：{tp1} / {tp2} / {tp3}。", "   观察价格：暂未形成合适区间，先观察。"),
        ("   不要追：如果价格已经超过 {no_chase_price}，这次就先放过。", "   不要追：等待更清楚的位置。"),
        ("   原因：{why}", None),
        ("   放弃条件：{rules}", None),
        ("", None),
    ),
}
PRICES = ("entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "no_chase_price")


def filled(pattern: str, values: dict[str, Column]) -> Column:
    """A text with ``{name}`` replaced by columns."""
    parts = []
    for i, piece in enumerate(pattern.replace("}", "{").split("{")):
        if i % 2:
            parts.append(values[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def _values() -> dict[str, Column]:
    long = F.col("direction") == "LONG"
    pick = lambda i: F.when(long, SIDE["LONG"][i]).otherwise(SIDE["SHORT"][i])
    strength = F.lit(STRENGTH_ELSE)
    for name, word in STRENGTH.items():
        strength = F.when(F.col("level") == name, word).otherwise(strength)
    sentence = lambda c: F.when(F.size(c) == 0, NO_REASON).otherwise(F.array_join(c, JOINER))
    out = {"symbol": F.col("symbol"), "score": F.col("score"), "act": pick(0), "move": pick(1), "strength": strength, "why": sentence("reasons"), "rules": sentence("invalidation_rules")}
    return out | {p: F.coalesce(number_text(F.col(p)), F.lit("")) for p in PRICES}


def single(signals: DataFrame) -> DataFrame:
    """Signals with subject and body of their message; a signal has a plan if it has an entry."""
    v, plan = _values(), F.col("entry_low").isNotNull()
    line = lambda a, b: filled(a, v) if b is None else F.when(plan, filled(a, v)).otherwise(filled(b, v))
    body = F.concat_ws("\n", *(line(*x) for x in SINGLE["lines"]), *map(F.lit, CLOSING))
    return signals.withColumns({"subject": F.when(plan, filled(SINGLE["subject"], v)).otherwise(filled(SINGLE["subject_without"], v)), "body": body})


def summary(signals: DataFrame, run: str = "run_id", order: str = "ord", runs: DataFrame | None = None) -> DataFrame:
    """One message per run: its signals by score, then by ``order``. A run's alerts are a handful.

    ``runs`` lists all runs; those without a signal get the message of an empty run.
    """
    v, plan = _values(), F.col("entry_low").isNotNull()
    ranked = v | {"rank": F.lit("\x01")}
    line = lambda a, b: filled(a, ranked) if b is None else F.when(plan, filled(a, ranked)).otherwise(filled(b, ranked))
    block = F.concat_ws("\n", *(line(*x) for x in SUMMARY["lines"]))
    head = filled(SUMMARY["subject"], v | {"n": F.lit("\x02")})
    rows = signals.select(run, F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"), block.alias("block"), head.alias("head")).alias("x"))
    out = rows.groupBy(run).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    n = F.size("xs").cast("string")
    blocks = F.transform("xs", lambda x, i: F.replace(x["block"], F.lit("\x01"), (i + 1).cast("string")))
    if runs is not None:  # a run without alerts has a message of its own
        out = runs.select(run).distinct().join(out, run, "left").withColumn("xs", F.coalesce("xs", F.array().cast(out.schema["xs"].dataType)))
        n = F.size("xs").cast("string")
    head = F.when(F.size("xs") == 0, F.lit(SUMMARY["subject_empty"])).otherwise(F.replace(F.get("xs", F.lit(0))["head"], F.lit("\x02"), n))
    return out.select(run, head.alias("subject"), F.concat_ws("\n", filled(SUMMARY["head"], {"n": n}), F.lit(""), blocks, *map(F.lit, CLOSING)).alias("body"))


def mime(sender: Column, sender_name: Column, to: Column, subject: Column, body: Column) -> Column:
    """A message as it is sent, with a closing line of one dot."""
    return F.concat(
        F.concat_ws(
            "\r\n",
            F.concat(F.lit("From: "), sender_name, F.lit(" <"), sender, F.lit(">")),
            F.concat(F.lit("To: "), to),
            F.concat(F.lit("Subject: =?UTF-8?B?"), F.replace(F.base64(F.encode(subject, "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("?=")),
            F.lit("MIME-Version: 1.0"),
            F.lit("Content-Type: text/plain; charset=utf-8"),
            F.lit("Content-Transfer-Encoding: 8bit"),
            F.lit(""),
            body,
            F.lit("."),
        ),
        F.lit("\r\n"),
    )


def sender(given: Column, fallback: Column) -> tuple[Column, Column]:
    """The name and address that a message is from."""
    email = F.coalesce(fallback, F.lit(""))
    name = F.trim(given)
    return F.when(F.length(name) > 0, name).otherwise(email), email
