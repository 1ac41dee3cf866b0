"""Runs of periodic words in texts, found by counting matches at each lag.

A run is a stretch of consecutive words, at least LEAST of them and at least twice its smallest
period long, that no neighbouring word extends. A run of period q and length m has m - q matches
(equal words q apart) one after another, so a lag with fewer matches than the shortest run needs
can't be the period of any. Matches are counted for all lags at once: for frequent words by an
exact FFT autocorrelation of where they stand (power spectra are added up and turned back once),
for rare ones by the differences of all pairs of places. What a run of period q matches at 2 q,
3 q, ... is taken off those lags; no run with such a period is lost by that, as two runs overlap
by less than the sum of their periods. Only lags with enough matches left are searched for
islands: hashes of aligned blocks of words, so long that every run holds one, tell where islands
may lie, and these places are compared word by word.

All lags together compare fewer than n log n block hashes, so long texts and texts of few
different words take little more than linear time beyond the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a run has at least, and at least so many times its period.
LEAST, TIMES = 12, 2
#: Pairs of places that are compared at once.
SLICE = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """How many equal words each lag from 0 (not counted) to half the text has; ``ids`` are numbers of words from 0."""
    n, half = len(ids), len(ids) // TIMES
    out, count = np.zeros(half + 1, np.int64), np.bincount(ids)
    size = 1 << (n + half).bit_length()
    heavy = count.astype(np.int64) ** 2 > size * size.bit_length() // 4 + 2000  # beyond that an FFT is cheaper than all pairs
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(heavy):
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: half + 1]).astype(np.int64)
    place = np.argsort(ids, kind="stable")
    first = np.repeat(np.cumsum(count) - count, count)  # where the places of each word begin
    earlier = np.arange(n) - first  # places of the same word before
    earlier[np.repeat(heavy, count)] = 0
    pairs = np.cumsum(earlier)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + SLICE, "right")))
        each = earlier[at:end]
        begun = np.repeat(np.cumsum(each) - each, each)
        lag = np.repeat(place[at:end], each) - place[np.repeat(first[at:end], each) + np.arange(len(begun)) - begun]
        out += np.bincount(lag[lag <= half], minlength=half + 1)
        at = end
    out[0] = 0
    return out


class _Blocks:
    """Hashes of any stretch of words, to be compared with those of another one."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ids: np.ndarray):
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), self.FACTOR)]), dtype=np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.power[:-1], dtype=np.uint64)])

    def alike(self, lag: int, length: int) -> np.ndarray:
        """The numbers of the blocks of ``length`` words whose hash is that of the words ``lag`` further on."""
        ends = self.sums[::length]  # of the blocks; those behind, cut alike
        behind = self.sums[lag::length]
        n = min(len(ends), len(behind)) - 1
        return np.flatnonzero((ends[1 : n + 1] - ends[:n]) * self.power[lag] == behind[1 : n + 1] - behind[:n])


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    left = lag_counts(ids)
    lags = np.arange(len(left))
    need = np.maximum(LEAST - lags, (TIMES - 1) * lags)
    found: dict[tuple[int, int], int] = {}
    blocks = None
    for lag in np.flatnonzero(left[1:] >= need[1:]) + 1:
        least = int(need[lag])
        if left[lag] < least:  # what is left after the runs found
            continue
        blocks = blocks or _Blocks(ids)
        length = (least + 1) // 2  # least >= 2 length - 1 matches in a row hold an aligned block
        alike = blocks.alike(int(lag), length)
        if not len(alike):
            continue
        lag, new = int(lag), []
        for group in np.split(alike, np.flatnonzero(np.diff(alike) > 1) + 1):
            low, high = max(0, (int(group[0]) - 1) * length), min(n - lag, (int(group[-1]) + 2) * length)
            equal = np.zeros(high - low + 2, np.int8)
            equal[1:-1] = ids[low:high] == ids[low + lag : high + lag]
            edges = np.flatnonzero(np.diff(equal))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= least and (low + int(a), low + int(b) + lag) not in found:  # else a smaller period's
                    found[low + int(a), low + int(b) + lag] = lag
                    new.append(int(b - a) + lag)
        for total in new:
            multiples = np.arange(2 * lag, min(total, len(left)), lag)
            left[multiples] -= total - multiples
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that repeat in a run: of each run the first period stays, unless another run drops it."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped[:-1]), strict=True) if d == 0]


def _found(texts: pa.Array) -> pa.Array:
    every, collapsed, counts = [], [], []
    for text in texts:
        words = (text.as_py() or b"").split()  # of bytes: at spaces and \x09-\x0D
        own = runs(_numbered(words)) if len(words) >= LEAST else []
        every.append([{"start": a, "length": m, "period": q} for a, m, q in own])
        collapsed.append(b" ".join(_kept(words, own) if own else words))
        counts.append(len(words))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(every, pa.list_(RUN)), pa.array(collapsed, pa.binary())], ["n_words", "runs", "collapsed"])


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeated periods, as words joined by one space.

    Words lie between spaces and the characters \\x09 to \\x0D; places count words from 0. A null or
    empty text has no words, no runs and an empty collapsed text. Every row is judged by its own
    text, so repeated rows and null ids don't matter; texts may be of any length, as far as one fits
    into a task. Columns of ``docs`` that have the name of a new one are replaced. An empty table
    gives an empty one.
    """
    found = F.arrow_udf(_found, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    fresh = "_periodic"
    while fresh in docs.columns:
        fresh = f"_{fresh}"
    out = docs.withColumn(fresh, found(F.col(f"`{text_col}`").cast("binary")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    return out.select(*kept, F.col(f"{fresh}.n_words").alias("n_words"), F.col(f"{fresh}.runs").alias("runs"), F.col(f"{fresh}.collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and words of ``docs`` as the query takes them: a tenth of the documents, by their id, repeat a part of their words to the end.

    A row without an id stays as it is.
    """
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", hashed.alias("_h"), F.col(f"`{text_col}`").alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("_p", (F.floor((n - F.col("_a")) / (g % 8 + 3)) + 1).cast("int"))
    tail = n - F.col("_a")
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(tail / F.col("_p")).cast("int"))), F.lit(1), tail)
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document: how many runs, the longest one, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length = -F.col("best.m")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)
), tab AS (SELECT list(v ORDER BY i) AS t FROM bytes),
d0 AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) AS h
  FROM documents, tab
), d1 AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0),
d AS (
  SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END AS INTEGER) + 1]) END AS w FROM d1
), p AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM d),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM p a JOIN p b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 2 * (b.i - a.i) <= a.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
s AS (SELECT r, q, min(i) AS a, count(*) + q AS l FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT r, a, l, min(q) AS q FROM s GROUP BY r, a, l),
gone AS (SELECT DISTINCT r, unnest(range(a + q, a + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM p ANTI JOIN gone USING (r, i) GROUP BY r),
every AS (SELECT r, count(*) AS n_runs, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS lines, arg_min(a, (-l, a, q)) AS a, arg_min(l, (-l, a, q)) AS l, arg_min(q, (-l, a, q)) AS q FROM runs GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(a AS BIGINT) AS "start", CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN every USING (r) LEFT JOIN kept USING (r)
"""
