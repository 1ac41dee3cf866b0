"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    # translate() looks every character up; lower() is the same where all are ASCII
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(_translated(text))


def _translated(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by spark.checkpoint.dir.

    Without the setting a local session (tests) gets a temporary folder. On a cluster a folder of
    one machine would lose tables, so there it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
    return named


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker, which Spark keeps for other tasks, gives free memory back to the machine."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    """Whether the columns of both tables are equal, nulls being equal to one another."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that further columns can't clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unpacked(row: str, columns: Iterable[str], **instead: Column) -> list[Column]:
    """The columns of a struct made by ``packed``, some with another value."""
    return [instead[c].alias(c) if c in instead else F.col(f"{row}.`{c}`").alias(c) for c in columns]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of executors without running
    the steps before again, and reads only the columns that it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
