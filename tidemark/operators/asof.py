"""Joins in time: the last row before, and intervals that overlap.

None compares all rows of a key, and none needs a key in one task: rows meet in chunks of time, and
what a chunk needs of earlier ones is carried over as one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, tie: str | None = None, chunk: int = 4096 * 900_000, within: int | None = None) -> DataFrame:
    """Each row of ``left`` with the columns of the last row of ``right`` of its keys whose ``right_at`` is not after ``at``.

    Of rows of equal time the one with the largest ``tie`` counts, or else the largest row. With
    ``within``, a row that is older than that is none. Rows of ``left`` without one stay, with nulls.
    Null times or keys of ``left`` find nothing; such rows of ``right`` are never found. ``chunk`` is
    the span of time whose rows of one key fit into a task; it doesn't change the result.
    """
    others = [c for c in right.columns if c not in keys]
    usable = F.col(at).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    alone = left.filter(~usable).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others))
    left = left.filter(usable)
    found = F.struct(*others)
    order = F.struct(F.col(right_at).alias("t"), *([F.col(tie).alias("tie")] if tie else []), *(F.col(c).alias(f"c_{c}") for c in others))
    old = right.filter(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), order.alias("_order"), found.alias("_found"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    new = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(old.schema["_order"].dataType).alias("_order"), F.lit(None).cast(old.schema["_found"].dataType).alias("_found"), F.struct(*left.columns).alias("_row"))
    rows = old.unionByName(new).withColumn("_chunk", F.floor(F.col("_at") / chunk))
    # the last row of each chunk, carried to the chunks after it
    last = rows.filter("_side = 0").groupBy(*keys, "_chunk").agg(F.max_by("_found", "_order").alias("_last"))
    chunks = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n")).join(last, [*keys, "_chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within_chunk = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    by = [*keys, "_chunk"]
    met = rows.join(carried.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_carried"), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    met = met.withColumn("_hit", F.coalesce(F.last("_found", ignorenulls=True).over(within_chunk), "_carried")).filter("_side = 1")
    fresh = F.lit(True) if within is None else F.col("_at") - F.col(f"_hit.{right_at}") <= within
    return met.select("_row.*", *(F.when(fresh, F.col(f"_hit.{c}")).alias(c) for c in others)).unionByName(alone)


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Pairs of rows whose intervals [start, end] share a point: two structs, l and r.

    An interval is repeated for each bucket of ``width`` that it touches, and rows meet by bucket; a pair is
    made in the one bucket in which the later of both begins. Choose ``width`` near the usual length.
    """
    spread = lambda df, name: df.select(F.struct(*df.columns).alias(name), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_bucket"))
    met = spread(left, "l").join(spread(right, "r"), "_bucket")
    later = F.greatest(F.col(f"l.{start}"), F.col(f"r.{start}"))
    return met.filter((later <= F.col(f"l.{end}")) & (later <= F.col(f"r.{end}")) & (F.floor(later / width) == F.col("_bucket"))).select("l", "r")


def exposure(rows: DataFrame, start: str, end: str, amounts: dict[str, Column], keys: list[str] = [], chunk: int = 4096 * 900_000) -> DataFrame:  # noqa: B006
    """How much is active over time, per ``keys``: a row for each time at which something begins or has ended, with the sum of each amount from then on.

    Intervals hold both their ends. A sweep over starts and ends, in chunks of time.
    """
    begun = rows.select(*keys, F.col(start).alias("at"), *(v.alias(k) for k, v in amounts.items()))
    ended = rows.select(*keys, (F.col(end) + 1).alias("at"), *((-v).alias(k) for k, v in amounts.items()))
    steps = begun.unionByName(ended).groupBy(*keys, "at").agg(*(F.sum(k).alias(k) for k in amounts))
    steps = steps.withColumn("_piece", F.floor(F.col("at") / chunk))
    return running(steps, keys, ["at"], ["_piece"], {f"{k}_active": ("sum", F.col(k)) for k in amounts}).select(*keys, "at", *(f"{k}_active" for k in amounts))
