"""Shares and ranks within moving spans of time, by a wavelet matrix per block of a series.

How many of the values of a span are at most the present one is a question of order statistics. A
wavelet matrix splits the ranks of a block's values bit by bit and keeps, for each bit, how many
zeros come before each place; each question then takes one step per bit. All questions of a block
are asked at once, so n rows take n log n steps, however many rows a span has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.operators.ordered import blocked

DAY = 86_400_000


class Wavelet:
    """Counts of the ranks below a bound among any stretch of a list of ranks."""

    def __init__(self, ranks: np.ndarray):
        self.bits = max(1, int(ranks.max(initial=0)).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (ranks >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            ranks = np.concatenate([ranks[one == 0], ranks[one == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many ranks from place ``low`` up to ``high`` are less than ``bound``."""
        bound = np.minimum(bound, 1 << self.bits)
        everything = bound == 1 << self.bits
        out = np.where(everything, high - low, 0)
        bound = np.where(everything, 0, bound)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b, one = zeros[low], zeros[high], (bound >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out


def percentiles(rows: DataFrame, values: list[str], days: list[int], key: str = "symbol", place: str = "open_time") -> DataFrame:
    """``rows`` with ``<value>_percentile_<days>d``: the share of the key's values of the last days, up to and with those of the same time, that are at most the present one, in percent to four decimals.

    Null and non-finite values are neither counted nor have a share; without any value in the span
    the share is null as well. Rows meet once for all values and spans, in blocks as wide as the
    longest span that repeat the block before, so a task holds the rows of twice that time of one key.
    """
    widest = max(days) * DAY
    held = blocked(rows, widest, widest, place=place)
    names = {(v, d): f"{v}_percentile_{d}d" for v in values for d in days}
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names.values())])

    def shares(part: pa.Table) -> pa.Table:
        part = part.sort_by(place)
        at, own = part.column(place).to_numpy(), np.flatnonzero(part.column("own").to_numpy())
        out = part.take(pa.array(own)).drop_columns(["own", "block"])
        high = np.searchsorted(at, at[own], "right")
        for v in values:
            x = part.column(v).cast(pa.float64()).to_numpy()
            there = np.isfinite(x)
            before = np.concatenate([[0], np.cumsum(there)])  # places among the values that count
            ranks = np.unique(x[there], return_inverse=True)[1].astype(np.int64)
            tree, bound = Wavelet(ranks), np.zeros(len(x), np.int64)
            bound[there] = ranks + 1
            for d in days:
                low = np.searchsorted(at, at[own] - d * DAY, "left")
                n = before[high] - before[low]
                share = tree.below(before[low], before[high], bound[own]) / np.maximum(n, 1) * 100
                out = out.append_column(names[v, d], pa.array(np.floor(share * 1e4 + 0.5) / 1e4, mask=~there[own] | (n == 0)))
        return out

    return held.groupBy(key, "block").applyInArrow(shares, schema)
