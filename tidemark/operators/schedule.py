"""Which candidates become trades."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dialect import Dialect
from tidemark.operators.ordered import BLOCK


def strided(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """Rows once for each polling step at whose places they lie; places count from the first bar that is evaluated."""
    at = F.col("seq") - dialect.least_seq
    steps = F.filter(F.array(*map(F.lit, dialect.steps)), lambda s: (at >= 0) & (at % s == 0))
    return rows.withColumn("step", F.explode(steps))


def _ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's candidates, their places, the place that is free after each, and the next candidate from there on."""
    seq = rows.column("seq").to_numpy()
    order = np.argsort(seq, kind="stable")
    seq = seq[order]
    free = seq + 1 + rows.column("duration").to_numpy()[order]
    return order, seq, free, np.searchsorted(seq, free)


def greedy(candidates: DataFrame, longest: int = 96) -> DataFrame:
    """In order of seq, per (step, symbol): a candidate is taken if no taken one is still active.

    A candidate is active up to seq + duration; no duration exceeds ``longest``. The choice depends
    on what came before by one number, the first free place, which lies at most ``longest`` into a
    block of bars. So each block tells for each such place where it would leave off; these short
    lists are joined in order per series; then all blocks take their candidates in parallel.
    A block has few rows, whatever the length or density of the series, and all blocks are dealt once.
    """
    size = max(BLOCK, longest + 1)
    rows = candidates.withColumn("_block", F.floor(F.col("seq") / size).cast("long"))
    key = ["step", "symbol", "_block"]

    def leaves(key: tuple, rows: pa.Table) -> pa.Table:
        _, seq, free, after = _ordered(rows)
        if len(seq) and int((free - seq).max()) > longest + 1:
            raise ValueError("a candidate is active for longer than the longest duration given")
        end = free.copy()  # where the chain that begins with each candidate leaves the block
        for i in range(len(seq) - 1, -1, -1):
            if after[i] < len(seq):
                end[i] = end[after[i]]
        entry = key[2].as_py() * size + np.arange(longest + 1)
        first = np.searchsorted(seq, entry)
        out = np.where(first < len(seq), np.append(end, 0)[np.minimum(first, len(seq))], entry)
        return pa.table({"step": pa.array([key[0].as_py()], pa.int32()), "symbol": [key[1].as_py()], "_block": [key[2].as_py()], "leaves": pa.array([out], pa.list_(pa.int64()))})

    def entries(key: tuple, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("_block")
        numbers, place, out = blocks.column("_block").to_pylist(), -1, []
        for number, left in zip(numbers, blocks.column("leaves"), strict=True):
            place = max(place, number * size)
            out.append(place)
            place = left.values[place - number * size].as_py()
        return pa.table({"step": pa.array([key[0].as_py()] * len(out), pa.int32()), "symbol": [key[1].as_py()] * len(out), "_block": numbers, "entry": pa.array(out, pa.int64())})

    def taken(rows: pa.Table, entry: pa.Table) -> pa.Table:
        order, seq, _, after = _ordered(rows)
        i, chosen = int(np.searchsorted(seq, entry.column("entry")[0].as_py())) if entry.num_rows else len(seq), []
        while i < len(seq):
            chosen.append(order[i])
            i = int(after[i])
        return rows.take(pa.array(chosen, pa.int64())).drop_columns("_block")

    left = rows.groupBy(*key).applyInArrow(leaves, "step int, symbol string, _block long, leaves array<long>")
    begun = left.groupBy("step", "symbol").applyInArrow(entries, "step int, symbol string, _block long, entry long")
    return rows.groupBy(*key).cogroup(begun.groupBy(*key)).applyInArrow(taken, candidates.schema)
