"""Structured Streaming: ticks to candles, and candles to a log of changed signals.

Tables that streams keep are Parquet folders, ``version=<batch>/bucket=<k>``: a batch writes the
buckets that it touches anew, and of each bucket the highest version counts. A batch that is run
again reads versions below its own only and overwrites its own, so each takes effect once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.js import millis
from tidemark.operators.state import changed, upserted
from tidemark.sources.candles import ohlc

#: Buckets of a stored table.
BUCKETS = 64


def candles(ticks: DataFrame, width: str = "15 minutes", late: str = "30 minutes", now: Column | None = None) -> DataFrame:
    """Ticks (symbol, ts, tie, price) as candles with the columns of batch candles.

    In append mode a bar comes out once, when the watermark has closed it. In update mode open bars
    come out too; ``now`` (ms) then tells which are closed. Of ticks of one time,
    to the nearest millisecond, ``tie`` decides which is first.
    """
    own = ticks.select("symbol", F.timestamp_millis(millis(F.col("ts"))).alias("ts"), "tie", F.col("price").cast("double").alias("price")).filter("price is not null and ts is not null")
    bars = own.withWatermark("ts", late).groupBy("symbol", F.window("ts", width)).agg(*ohlc(F.struct("ts", "tie")))
    at = F.unix_millis
    out = bars.withColumns({"open_time": at("window.start"), "close_time": at("window.end") - 1})
    return out.withColumn("is_closed", F.lit(True) if now is None else F.col("close_time") < now).drop("window")


def _timed(ticks: DataFrame, late: str | None) -> DataFrame:
    """Ticks with a time and a price; a cast would take the watermark off their time, so a timestamp stays as it is."""
    own = ticks if isinstance(ticks.schema["ts"].dataType, T.TimestampType) else ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.filter("price is not null and ts is not null").withColumn("price", F.col("price").cast("double"))
    return own.withWatermark("ts", late) if ticks.isStreaming and late else own


def hopping(ticks: DataFrame, width: str = "1 hour", every: str = "15 minutes", late: str | None = "30 minutes") -> DataFrame:
    """Bars of ``width``, a new one each ``every``: symbol, open_time, close_time and the columns of a bar.

    For streams and tables alike; on a stream a bar comes out when the watermark, ``late`` behind the newest tick, has passed its end. Ticks that have a watermark already come with ``late`` None. Ticks without a time or price are dropped.
    """
    own = _timed(ticks, late)
    bars = own.groupBy("symbol", F.window("ts", width, every)).agg(*ohlc(F.struct("ts", "tie")))
    return bars.withColumns({"open_time": F.unix_millis("window.start"), "close_time": F.unix_millis("window.end") - 1}).drop("window")


def sessions(ticks: DataFrame, gap: str = "2 hours", late: str | None = "30 minutes") -> DataFrame:
    """Runs of ticks without a gap: symbol, start and end (ms, the gap included), ticks, low and high; a run ends where no tick follows within ``gap``.

    For streams and tables alike, as ``hopping``.
    """
    own = _timed(ticks, late)
    runs = own.groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("ticks"), F.min("price").alias("low"), F.max("price").alias("high"))
    return runs.select("symbol", F.unix_millis("s.start").alias("start"), F.unix_millis("s.end").alias("end"), "ticks", "low", "high")


def unique(ticks: DataFrame, late: str = "30 minutes") -> DataFrame:
    """A stream of ticks without those that come again within ``late`` of their time: one per symbol and tie."""
    return _timed(ticks, late).dropDuplicatesWithinWatermark(["symbol", "tie"])


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def current(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """The rows of a stored table that count, with their bucket; with ``below``, as they were before that batch."""
    kept = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(kept).parquet(path)
    if below is not None:
        rows = rows.filter(F.col("version") < below)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # BUCKETS rows at most
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").select(*schema.names, "bucket")


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps one row per key in a stored table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("bucket", _bucket(keys))
        if batch_id > 0:
            touched = new.select("bucket").distinct()
            old = current(batch.sparkSession, path, batch.schema, batch_id).join(F.broadcast(touched), "bucket", "left_semi")
            new = upserted(old.select(*new.columns), new, [*keys, "bucket"], order)
        else:
            new = upserted(new.limit(0), new, [*keys, "bucket"], order)
        new.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")

    return write


def log_changes(path: str, key: str = "opportunity_id", order: str = "created_ms") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends signals whose state differs from the last one logged to ``path/log``.

    It shares its rule with the batch log. The last state of each key is a stored table, so a batch
    reads the buckets that it touches and no earlier log.
    """
    columns = [key, order, "level", "lifecycle_status"]
    keep = upsert_into(f"{path}/last", [key], order)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*columns).withColumn("_new", F.lit(True))
        if batch_id > 0:
            touched = fresh.select(_bucket([key]).alias("bucket")).distinct()
            last = current(spark, f"{path}/last", batch.select(*columns).schema, batch_id).join(F.broadcast(touched), "bucket", "left_semi")
            fresh = fresh.unionByName(last.select(*columns).withColumn("_new", F.lit(False)))
        changed(fresh, key, order).filter("_new").select(*columns).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        keep(batch.select(*columns), batch_id)

    return write


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All signals logged so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/log")


def started(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "15 minutes", mode: str = "update") -> StreamingQuery:
    """The running stream: every so often, or with ``every`` None once over all that there is."""
    out = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start()


def signal_stream(path: str, evaluate: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function from candles to logged signals.

    A batch's bars are put into the stored candles; ``evaluate`` makes signals of the stored candles, of
    which those of the batch's bars go to the log.
    """
    keep = upsert_into(f"{path}/candles", ["symbol", "open_time"], "close_time")
    log = log_changes(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for the table and for the log
        keep(batch, batch_id)
        stored = current(batch.sparkSession, f"{path}/candles", batch.schema, batch_id + 1).drop("bucket")
        bars = batch.filter("is_closed").select("symbol", "open_time")
        log(evaluate(stored.filter("is_closed")).join(bars, ["symbol", "open_time"], "left_semi"), batch_id)
        batch.unpersist()

    return write
