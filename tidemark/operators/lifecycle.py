"""What becomes of signals and opportunities, bar by bar: the declared lifecycle as state machines.

The states are fixed; no rules for them are. Ours: a planned signal waits for its entry; while it
waits, a close far beyond the entry is not to be chased (and may come back), a close beyond the stop
or data of low quality make it invalid; once entered it ends at the first level touched; what has
not ended after the horizon is expired; and some bars later everything is archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.machine import Machine, replayed
from tidemark.operators.ordered import BLOCK, followed
from tidemark.operators.risk import QUALITY_LEAST

# States in which a signal may end.
HITS = ("hit_sl", "hit_tp3", "hit_tp2", "hit_tp1")
_PRICE, _LEVEL = ("bad", "touch", "broken", "away", "near"), ("", *HITS)


def _signal_rules() -> dict[tuple[str, str], str]:
    rules, waiting = {}, ("planned", "waiting_entry", "no_chase")
    for level in _LEVEL:
        for price in _PRICE:
            seen = f"{price}:{level}"
            after = {"bad": "invalidated", "touch": level or "entered", "broken": "invalidated", "away": "no_chase", "near": "waiting_entry"}[price]
            rules |= {(s, seen): after for s in waiting}
            if level:
                rules["entered", seen] = level
    rules |= {(s, "over"): "expired" for s in (*waiting, "entered")}
    return rules | {(s, "closed"): "archived" for s in (*waiting, "entered", "expired", "invalidated", *HITS)}


SIGNAL = Machine(("planned", "waiting_entry", "entered", "no_chase", "expired", "invalidated", *HITS, "archived"), (*(f"{p}:{v}" for p in _PRICE for v in _LEVEL), "over", "closed"), _signal_rules())

# An opportunity in one direction: what each bar says of it.
OPPORTUNITY = Machine(
    ("archived", "detected", "watching", "setup_confirmed", "planned", "expired", "invalidated"),
    ("quiet", "detected", "watching", "planned", "broken"),
    {
        **{(s, "quiet"): to for s, to in {"detected": "archived", "watching": "detected", "setup_confirmed": "watching", "planned": "expired", "expired": "archived", "invalidated": "archived"}.items()},
        **{(s, "detected"): to for s, to in {"archived": "detected", "watching": "detected", "setup_confirmed": "watching", "planned": "expired", "expired": "detected", "invalidated": "detected"}.items()},
        **{(s, "watching"): to for s, to in {"archived": "watching", "detected": "watching", "watching": "setup_confirmed", "planned": "setup_confirmed", "expired": "watching", "invalidated": "detected"}.items()},
        **{(s, "planned"): "planned" for s in ("archived", "detected", "watching", "setup_confirmed", "expired")},
        ("invalidated", "planned"): "setup_confirmed",
        **{(s, "broken"): "invalidated" for s in ("detected", "watching", "setup_confirmed", "planned", "expired")},
    },
)


def _event(age: Column, horizon: int, archive: int) -> Column:
    """What a bar is to a signal whose plan fields stand beside it."""
    long = F.col("direction") == "LONG"
    high, low, close = F.col("bar.high"), F.col("bar.low"), F.col("bar.close")
    beyond = lambda level: F.when(long, high >= F.col(level)).otherwise(low <= F.col(level))
    level = F.when(F.when(long, low <= F.col("stop_loss")).otherwise(high >= F.col("stop_loss")), "hit_sl").when(beyond("tp3"), "hit_tp3").when(beyond("tp2"), "hit_tp2").when(beyond("tp1"), "hit_tp1").otherwise("")
    price = (
        F.when(F.col("bar.quality") < QUALITY_LEAST, "bad")
        .when((low <= F.col("entry_high")) & (high >= F.col("entry_low")), "touch")
        .when(F.when(long, close < F.col("stop_loss")).otherwise(close > F.col("stop_loss")), "broken")
        .when(F.when(long, close > F.col("no_chase_price")).otherwise(close < F.col("no_chase_price")), "away")
        .otherwise("near")
    )
    return F.when(age == horizon + archive, "closed").when(age > horizon, "over").otherwise(F.concat_ws(":", price, level))


PLAN = ["symbol", "seq", "direction", "entry_low", "entry_high", "stop_loss", "tp1", "tp2", "tp3", "no_chase_price"]


def signal_states(signals: DataFrame, bars: DataFrame, horizon: int, archive: int, size: int = BLOCK) -> DataFrame:
    """symbol, seq, at and state: each signal's state at its own bar and the next ones.

    ``signals`` have the columns PLAN, ``bars`` symbol, seq, high, low, close and quality. A series
    that ends before a signal does leaves it in its last state. Signals are told apart by symbol and seq.
    """
    own = signals.select(*PLAN)
    after = followed(own, bars.select("symbol", "seq", "high", "low", "close", "quality"), horizon + archive)
    after = after.select("symbol", "seq", "at", _event(F.col("at") - F.col("seq"), horizon, archive).alias("event"))
    rows = own.select("symbol", "seq", F.col("seq").alias("at"), F.lit(None).cast("string").alias("event")).unionByName(after)
    return replayed(rows, SIGNAL, ["symbol", "seq"], F.col("event"), "at", size=size).drop("event")


def opportunity_states(evaluations: DataFrame, size: int = BLOCK) -> DataFrame:
    """symbol, side, seq and state: for both directions of each symbol, the state of its opportunity at every evaluated bar."""
    sides = evaluations.select("symbol", "seq", "direction", "lifecycle_status", "quality", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side"))
    event = F.when(F.col("quality") < QUALITY_LEAST, "broken").when(F.col("direction") != F.col("side"), "quiet").otherwise(F.col("lifecycle_status"))
    rows = sides.select("symbol", "side", "seq", event.alias("event"))
    return replayed(rows, OPPORTUNITY, ["symbol", "side"], F.col("event"), "seq", size=size).drop("event")
