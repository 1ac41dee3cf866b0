"""Breakouts of a narrow range, as sequences of bars that a state machine recognises.

The signal type and its way of entry are declared without a rule. Ours: a bar is a set-up if the
range of the last bars is narrow against their mean true range. Of the bars after it the first that
closes outside the range decides: on strong volume it breaks out, otherwise it only drifts. A break
is confirmed by another close on that side within the next bars; a close beyond the other side, or
none on its own side in time, makes it fail. Bars that all stay inside time out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import Dialect
from tidemark.operators import plan
from tidemark.operators.machine import Machine, replayed
from tidemark.operators.ordered import BLOCK, followed


@dataclass(frozen=True)
class Pattern:
    """Thresholds: the widest range in mean true ranges, the least volume ratio of a break, the bars within which it comes, and those within which it is confirmed."""

    width: float = 4.0
    volume: float = 1.5
    within: int = 8
    confirm: int = 4

    def machine(self) -> Machine:
        """States ``waiting_i``, ``up_i`` and ``down_i`` count bars; the others are outcomes."""
        rules: dict[tuple[str, str], str] = {}
        for i in range(self.within):
            now, later = f"waiting_{i}", f"waiting_{i + 1}" if i + 1 < self.within else "timed_out"
            rules |= {(now, "inside"): later, (now, "above"): "drifted", (now, "below"): "drifted", (now, "above_strong"): "up_0", (now, "below_strong"): "down_0"}
        for side, own, other in (("up", "above", "below"), ("down", "below", "above")):
            for i in range(self.confirm):
                now, later = f"{side}_{i}", f"{side}_{i + 1}" if i + 1 < self.confirm else "failed"
                rules |= {(now, f"{own}{s}"): f"confirmed_{side}" for s in ("", "_strong")} | {(now, f"{other}{s}"): "failed" for s in ("", "_strong")} | {(now, "inside"): later}
        states = [*(f"waiting_{i}" for i in range(self.within)), *(f"{s}_{i}" for s in ("up", "down") for i in range(self.confirm)), "confirmed_up", "confirmed_down", "failed", "drifted", "timed_out"]
        return Machine(tuple(states), ("inside", "above", "below", "above_strong", "below_strong"), rules)


OUTCOMES = ("confirmed_up", "confirmed_down", "failed", "drifted", "timed_out")


def setups(features: DataFrame, pattern: Pattern) -> DataFrame:
    """Bars whose structure is narrow; without a true range there is none."""
    return features.filter((F.col("atr") > 0) & (F.col("structure_high") - F.col("structure_low") <= F.col("atr") * pattern.width))


def outcomes(features: DataFrame, pattern: Pattern, size: int = BLOCK) -> DataFrame:
    """symbol, seq, range_low, range_high, outcome and decided (the seq of the bar that decides) of each set-up.

    A set-up whose bars end before it is decided has the outcome ``pending`` and no such bar.
    """
    starts = setups(features, pattern).select("symbol", "seq", F.col("structure_low").alias("range_low"), F.col("structure_high").alias("range_high"))
    rows = followed(starts, features.select("symbol", "seq", "close", "volume_ratio"), pattern.within + pattern.confirm)
    side = F.when(F.col("bar.close") > F.col("range_high"), "above").when(F.col("bar.close") < F.col("range_low"), "below")
    event = F.when(side.isNull(), "inside").when(F.col("bar.volume_ratio") >= pattern.volume, F.concat(side, F.lit("_strong"))).otherwise(side)
    states = replayed(rows.select("symbol", "seq", "at", event.alias("event")), pattern.machine(), ["symbol", "seq"], F.col("event"), "at", size=size)
    ended = states.filter(F.col("state").isin(*OUTCOMES)).groupBy("symbol", "seq").agg(F.min_by("state", "at").alias("outcome"), F.min("at").alias("decided"))
    return starts.join(ended, ["symbol", "seq"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))


def signals(features: DataFrame, ended: DataFrame, dialect: Dialect) -> DataFrame:
    """One signal for each bar and direction in which breakouts are confirmed: how many set-ups it confirms, the first of them, and the plan built at that bar."""
    good = ended.filter(F.col("outcome").isin("confirmed_up", "confirmed_down"))
    direction = F.when(F.col("outcome") == "confirmed_up", "LONG").otherwise("SHORT").alias("direction")
    good = good.groupBy("symbol", F.col("decided").alias("seq"), direction).agg(F.count("*").alias("setups"), F.min("seq").alias("first_setup"))
    rows = good.join(features.select("symbol", "seq", "open_time", "close", "atr", "structure_low", "structure_high"), ["symbol", "seq"])
    made = plan.build(F.col("direction"), F.col("close"), F.col("atr"), F.col("structure_low"), F.col("structure_high"), dialect.plan_scale)
    return rows.withColumns({**made, "signal_type": F.lit("volume_breakout"), "entry_mode": F.lit("breakout_confirm")})
