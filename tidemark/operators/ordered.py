"""Series in pieces: numbers, frames and running totals without a whole series in one task.

A series may be a third of all rows. Its rows are numbered through counts per time chunk;
frames of bounded length are then computed in blocks of rows that repeat the last rows of the
block before (or the first ones of the block after); running totals add what all earlier blocks
sum up to; the row before is that of the same chunk, or the last one of the chunk before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _tie(df: DataFrame) -> Column:
    """What puts rows of equal time in an order that repeats: their content."""
    return F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind))


def numbered(df: DataFrame, key: str | list[str] = "symbol", order: str = "open_time", chunk: int = BLOCK * 900_000, place: str = "seq", count: str = "bars", then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``place``, the row's place in its series from 0, and ``count``, the length of the series.

    Rows of equal ``order`` follow one another by the columns ``then`` and a hash of their content.
    """
    keys = [key] if isinstance(key, str) else key
    tie = _tie(df)
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sizes = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    series = Window.partitionBy(*keys)
    before = series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(series).alias(count))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order, *then, tie))
    return df.withColumn("_within", within).join(sizes, [*keys, "_chunk"]).withColumn(place, F.col("_before") + F.col("_within") - 1).drop("_chunk", "_within", "_before")


def blocked(df: DataFrame, halo: int, size: int = BLOCK, ahead: int = 0, place: str = "seq") -> DataFrame:
    """``df`` with block, and own: false for rows that a block repeats: the last ``halo`` ones of the block before, the first ``ahead`` ones of the block after.

    ``size`` is at least as large as both. With a time as ``place``, all three are spans of time.
    """
    at, home = F.pmod(F.col(place), F.lit(size)), F.floor(F.col(place) / size)
    blocks = F.array_compact(F.array(home, F.when(at >= size - halo, home + 1), F.when(at < ahead, home - 1)))
    return df.withColumn("block", F.explode(blocks)).withColumn("own", F.floor(F.col(place) / size) == F.col("block"))


def running(df: DataFrame, keys: list[str], order: list[str], piece: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running totals per ``keys`` in the order of ``piece`` and then ``order``.

    ``totals``: name -> (sum | max, value). A piece is a run of rows that fits into a task; ``piece``
    and ``order`` together order the rows of a key.
    """
    ways = {"sum": (F.sum, F.lit(0), lambda a, b: a + b), "max": (F.max, F.lit(None), F.greatest)}
    values = {f"_{name}": value for name, (_, value) in totals.items()}
    df = df.withColumns(values)
    inner = Window.partitionBy(*keys, *piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(*keys, *piece).agg(*(ways[way][0](f"_{name}").alias(f"_{name}") for name, (way, _) in totals.items()))
    whole = whole.select(*keys, *piece, *(F.coalesce(ways[way][0](f"_{name}").over(outer), ways[way][1]).alias(f"_b_{name}") for name, (way, _) in totals.items()))
    df = df.join(whole, [*keys, *piece])
    return df.withColumns({name: ways[way][2](ways[way][0](f"_{name}").over(inner), F.col(f"_b_{name}")) for name, (way, _) in totals.items()}).drop(*values, *(f"_b_{n}" for n in totals))


def before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: int) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row before per ``keys`` in the order of ``order``; null for the first.

    ``chunk`` is the span of ``order`` whose rows of one key fit into a task. Rows of equal
    ``order`` follow one another by a hash of their content.
    """
    tie = _tie(df)
    df = df.withColumns({"_chunk": F.floor(F.col(order) / chunk), "_tie": tie, "_value": F.struct(value.alias("v"))})
    last = df.groupBy(*keys, "_chunk").agg(F.max_by("_value", F.struct(order, "_tie")).alias("_last"))
    last = last.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_last"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order, "_tie")
    return df.join(last, [*keys, "_chunk"]).withColumn(name, F.coalesce(F.lag("_value").over(inner), "_last")["v"]).drop("_chunk", "_tie", "_value", "_last")


def followed(starts: DataFrame, bars: DataFrame, ahead: int, key: str = "symbol") -> DataFrame:
    """Each of ``starts`` (with seq) beside each of the ``ahead`` rows of ``bars`` (seq and others) after it: their columns, bar (a struct) and at, the bar's seq.

    An equi-join on buckets as wide as ``ahead``: a start meets two of them, whatever the length of a series.
    """
    size = F.lit(ahead)
    left = starts.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("seq") + 1) / size), F.floor((F.col("seq") + size) / size))))
    right = bars.select(key, F.floor(F.col("seq") / size).alias("_bucket"), F.col("seq").alias("at"), F.struct(*(c for c in bars.columns if c not in (key, "seq"))).alias("bar"))
    return left.join(right, [key, "_bucket"]).filter((F.col("at") > F.col("seq")) & (F.col("at") <= F.col("seq") + size)).drop("_bucket")
