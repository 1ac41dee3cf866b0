"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal text form a group. Groups are dealt into units: a group with a large share
of any total is a unit of its own, cut into pieces row by row where it exceeds the
largest unit; all others are hashed into a fixed number of bundles. The units are few by
construction, so they are placed on the driver, largest first: each goes to the shard
where the dot product of its vector and the shard's residual capacity is highest. Bundling
costs balance: a shard's total can't be met more closely than by a bundle, on average
1 / MIN_BUNDLES of everything, or 0.6 % of one of 24 shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Bytes that each row counts for besides its text.
ROW_OVERHEAD = 8
#: A unit has at most this part of a shard's capacity, unless one row has more.
UNIT_PART = 1 / 64
#: Bundles of small groups at least, rows that a bundle should have, and bundles at most.
MIN_BUNDLES, BUNDLE_ROWS, MAX_BUNDLES = 4096, 250_000, 1 << 18
MEASURES = ("size", "tokens", "one")
#: What counts as a token where no column says how many a row has: a word, a number, or a run of marks.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def measured(docs: DataFrame, text: Column, tokens: Column | None = None) -> DataFrame:
    """Size, tokens, checksum and group of each row, and a number of its own; the text itself goes no further."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_count(text, F.lit(TOKEN)) if tokens is None else F.coalesce(tokens, F.lit(0))
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        tokens.cast("long").alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("group"),
    ).withColumn("one", F.lit(1).cast("long"))


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each vector: the largest first, each where its dot product with the residual capacity is highest."""
    total = vectors.sum(axis=0, dtype=float)
    parts = vectors / np.where(total > 0, total, 1)
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-parts.max(axis=1), kind="stable"):
        out[i] = best = int(np.argmax(residual @ parts[i]))
        residual[best] -= parts[i]
    return out


def shard(docs: DataFrame, shards: int = 24, text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``bytes``: shards have near equal bytes (and tokens and rows). ``tokens`` says how
    many tokens a row has; without it, those that TOKEN finds in the text are counted. Rows of equal
    text share a shard unless they have more than UNIT_PART of a shard's capacity; then they are
    cut row by row, whatever their ids, null and repeated ones too. A null text has no bytes and
    counts as an empty one. Repeated rows are rows of their own. An empty table gives an empty
    result. Other columns are ignored. ``slot`` counts from 0 in each shard without gaps.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = written(measured(docs, F.col(text_col), tokens), "sharding-rows")
    spark = rows.sparkSession
    total = rows.agg(*(F.sum(m).alias(m) for m in MEASURES)).first()
    bundles = min(MAX_BUNDLES, max(MIN_BUNDLES, (total["one"] or 0) // BUNDLE_ROWS))
    limit = {m: max(1.0, (total[m] or 0) / shards * UNIT_PART) for m in MEASURES}
    groups = rows.groupBy("group").agg(*(F.sum(m).alias(m) for m in MEASURES))
    share = F.greatest(*(F.col(m) / limit[m] for m in MEASURES))
    # at most 3 * shards / UNIT_PART groups are that large, whatever the input
    large = groups.select("group", share.alias("share")).filter("share >= 1").orderBy("group").collect()
    first, pieces = bundles, []
    for g in large:
        n = 2 * math.ceil(g["share"]) if g["share"] > 1.5 else 1
        pieces.append((g["group"], first, n))
        first += n
    cut = spark.createDataFrame(pieces, "group string, first_unit long, pieces long")
    unit = F.coalesce(
        F.col("first_unit") + F.pmod(F.xxhash64(F.lit("piece"), "row"), F.col("pieces")),
        F.pmod(F.xxhash64("group"), F.lit(bundles)),
    )
    dealt = rows.join(F.broadcast(cut), "group", "left").withColumn("unit", unit)
    # as many rows as there are units, a number fixed above
    units = dealt.groupBy("unit").agg(*(F.sum(m).alias(m) for m in MEASURES)).orderBy("unit").collect()
    to = place(np.array([[u[m] for m in MEASURES] for u in units], float).reshape(-1, len(MEASURES)), shards)
    filled, places = [0] * shards, []
    for u, s in zip(units, to.tolist(), strict=True):
        places.append((u["unit"], s, filled[s]))
        filled[s] += u["one"]
    placed = spark.createDataFrame(places, "unit long, shard int, first_slot long")
    order = Window.partitionBy("unit").orderBy("doc_id", "size", "text_crc32", "row")
    return dealt.join(F.broadcast(placed), "unit").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
