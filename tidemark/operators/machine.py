"""Finite-state machines over ordered series of any length.

What a block of rows does to a machine is one map, from the state before to the state after. Blocks
are mapped in parallel; the maps of a series, one short list per block, are composed in order, which
tells in which state each block begins; then all blocks are replayed in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import BLOCK


@dataclass(frozen=True)
class Machine:
    """States, the first of which a series begins in, events, and rules (state, event) -> state; without a rule a state stays."""

    states: tuple[str, ...]
    events: tuple[str, ...]
    rules: Mapping[tuple[str, str], str]

    def table(self) -> np.ndarray:
        """The next state's number by event and state."""
        place = {s: i for i, s in enumerate(self.states)}
        return np.array([[place[self.rules.get((s, e), s)] for s in self.states] for e in self.events], np.int64)

    def number(self, event: Column) -> Column:
        """An event's number; null for one that the machine doesn't know, which leaves every state as it is."""
        known = F.create_map(*(F.lit(x) for i, e in enumerate(self.events) for x in (e, i)))
        return F.try_element_at(known, event)


def replayed(rows: DataFrame, machine: Machine, keys: list[str], event: Column, place: str = "seq", name: str = "state", size: int = BLOCK) -> DataFrame:
    """``rows`` with the state after each one's event, per ``keys`` in the order of ``place``.

    Rows of equal ``place`` follow one another by the event's number. ``keys`` and ``place`` hold no
    nulls. A null event, or one that the machine doesn't know, changes nothing. An empty table stays
    empty. The result doesn't depend on ``size``, the span of ``place`` that is one block.
    """
    table, states = machine.table(), machine.states
    rows = rows.withColumns({"_event": machine.number(event).cast("int"), "_block": F.floor(F.col(place) / size).cast("long")})
    kinds = [rows.schema[k] for k in (*keys, "_block")]
    of_block = T.StructType([*kinds, T.StructField("_map", T.ArrayType(T.LongType()))])
    begins = T.StructType([*kinds, T.StructField("_begin", T.LongType())])

    def ordered(part: pa.Table) -> tuple[np.ndarray, list[int]]:
        event_ = part.column("_event").fill_null(-1).to_numpy()
        order = np.lexsort((event_, part.column(place).to_numpy()))
        return order, event_[order].tolist()

    def mapped(key: tuple, part: pa.Table) -> pa.Table:
        now = np.arange(len(states))
        for e in ordered(part)[1]:
            if e >= 0:
                now = table[e][now]
        own = {f.name: pa.array([k.as_py()], k.type) for f, k in zip(kinds, key, strict=True)}
        return pa.table(own | {"_map": pa.array([now.tolist()], pa.list_(pa.int64()))})

    def composed(part: pa.Table) -> pa.Table:
        part = part.sort_by("_block")
        now, out = 0, []
        for each in part.column("_map").to_pylist():
            out.append(now)
            now = each[now]
        return part.drop_columns("_map").append_column("_begin", pa.array(out, pa.int64()))

    def run(part: pa.Table) -> pa.Table:
        order, events = ordered(part)
        moves, now, out = table.tolist(), part.column("_begin")[0].as_py(), []
        for e in events:
            now = now if e < 0 else moves[e][now]
            out.append(states[now])
        return part.take(pa.array(order)).drop_columns(["_event", "_block", "_begin"]).append_column(name, pa.array(out, pa.string()))

    maps = rows.select(*keys, "_block", place, "_event").groupBy(*keys, "_block").applyInArrow(mapped, of_block)
    begun = maps.groupBy(*keys).applyInArrow(composed, begins)
    out = T.StructType([*(f for f in rows.schema.fields if f.name not in ("_event", "_block")), T.StructField(name, T.StringType())])
    return rows.join(begun, [*keys, "_block"]).select(*rows.columns, "_begin").groupBy(*keys, "_block").applyInArrow(run, out)
