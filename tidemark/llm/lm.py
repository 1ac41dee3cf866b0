"""Scores of whole texts by prediction by partial matching over their bytes, and by counts of their tokens.

The trie (``ppm``) is trained on the running training texts: each byte with the ORDER bytes
before it is an n-gram, counted with all its occurrences. A byte's probability is set by its
n-gram alone, so each distinct n-gram is coded once, and a text's score is the sum over its
bytes. Every n-gram is kept: they are a table that grows with the corpus.

Contexts of HEAD bytes or more are coded where all n-grams that share their nearest HEAD
bytes lie, next to each other in one partition; the shorter ones, at most 256**HEAD n-grams,
are broadcast. The most frequent n-grams and tokens, a fixed number, are broadcast to where
texts are read; the others of each text are joined with the table. None of these is
frequent, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ppm, shingles
from tidemark.llm.common import lean, written
from tidemark.llm.quality import held_out

#: Most frequent tokens, and n-grams, that are broadcast (16 bytes each).
FREQUENT, FREQUENT_GRAMS = 1 << 18, 1 << 20
#: Keys of single slices that a worker holds before it adds up equal ones, different keys after which it hands on its counts, and rows that it hands on at once.
LOOSE_KEYS, COUNTED_KEYS, ROWS_AT_ONCE = 400_000, 1_000_000, 50_000
#: Nearest bytes of a context by which n-grams are brought together, and n-grams coded at once (more where more share these bytes).
HEAD, GRAMS_AT_ONCE = 3, 200_000

U = np.uint64
#: The key of the end of a text, a token without bytes.
END = np.int64(0)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens with the end after each text's words, and their bounds."""
    words, bounds = shingles.word_hashes(texts)
    return np.insert(words.view(np.int64), bounds[1:], END), bounds + np.arange(len(bounds))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of each byte of the texts' running, lower-cased words, and each text's number of them."""
    raw, begins, last = shingles.word_spans(texts)
    text_of = np.searchsorted(shingles.strings(texts)[1], begins, "right") - 1
    keys, sizes = ppm.running(shingles.LOWER[raw], ~shingles._SPACE[raw], last - begins, text_of, len(texts))
    return keys.view(np.int64), sizes


def _counted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _occurrences(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, their occurrences, and those in training texts."""
    parts = []
    for k, known in ((keys[~training], 0), (keys[training], 1)):
        k = np.sort(k)
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, int)
        n = np.diff(np.append(at, len(k)))
        parts.append((k[at], n, n * known))
    return _counted(*(np.concatenate(p) for p in zip(*parts, strict=True)))


def count(docs: DataFrame) -> DataFrame:
    """(gram, key, total, known): occurrences of each distinct token and n-gram (``gram``) in all texts, and in training texts.

    ``docs`` has ``text`` and ``training``. Workers count before anything is shuffled.
    """

    def added(held: list) -> tuple:
        return tuple(_counted(*(np.concatenate(part) for part in zip(*(h[gram] for h in held), strict=True))) for gram in (False, True))

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        for gram, columns in enumerate(held[0] if len(held) == 1 else added(held)):
            for at in range(0, len(columns[0]), ROWS_AT_ONCE):
                key, total, known = (c[at : at + ROWS_AT_ONCE] for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), bool(gram))), pa.array(key), pa.array(total), pa.array(known)], ["gram", "key", "total", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, loose = [], 0
        for batch in batches:
            column, training = batch.column("text"), np.array(batch.column("training"))
            for a, b in shingles.slices(column):
                texts = column.slice(a, b - a)
                tokens, bounds = _tokens(texts)
                grams, sizes = _grams(texts)
                held.append((_occurrences(tokens, np.repeat(training[a:b], np.diff(bounds))), _occurrences(grams, np.repeat(training[a:b], sizes))))
                loose += sum(len(columns[0]) for columns in held[-1])
                if loose > LOOSE_KEYS:
                    held, loose = [added(held)], 0
                    if sum(len(columns[0]) for columns in held[0]) > COUNTED_KEYS:
                        yield from flush(held)
                        held = []
        if held:
            yield from flush(held)

    counted = docs.select("text", "training").mapInArrow(lean(run), "gram boolean, key long, total long, known long")
    return counted.groupBy("gram", "key").agg(F.sum("total").alias("total"), F.sum("known").alias("known"))


def code(counted: DataFrame, at_once: int = GRAMS_AT_ONCE) -> DataFrame:
    """(key, total, code) of each n-gram: the log10 probability of its last byte after the others."""
    grams = counted.filter("gram").select("key", "total", "known")
    low = grams.filter("known > 0").groupBy(F.col("key").bitwiseAND((1 << (8 * HEAD)) - 1).alias("key")).agg(F.sum("known").alias("n")).toArrow()
    short = ppm.levels(low.column("key").to_numpy().astype(U), low.column("n").to_numpy(), HEAD - 1, 0)
    shared = counted.sparkSession.sparkContext.broadcast(short)

    def coded(key: np.ndarray, total: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        grams = key.astype(U)
        some = known > 0
        trie = ppm.Trie(*map(np.concatenate, zip(ppm.levels(grams[some], known[some], ppm.ORDER, HEAD), shared.value, strict=True)))
        each = trie.each(grams >> U(8), grams & U(255), np.full(len(grams), ppm.ORDER))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(total), pa.array(each)], ["key", "total", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "total", "known", "near")])
            size += batch.num_rows
            if size >= at_once:
                key, total, known, near = map(np.concatenate, zip(*held, strict=True))
                cut = int(np.searchsorted(near, near[-1]))  # all that share their nearest bytes stay together
                if cut:
                    yield coded(key[:cut], total[:cut], known[:cut])
                held, size = [[key[cut:], total[cut:], known[cut:], near[cut:]]], size - cut
        if size:
            yield coded(*list(map(np.concatenate, zip(*held, strict=True)))[:3])

    near = F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * HEAD)) - 1)
    together = grams.withColumn("near", near).repartition("near").sortWithinPartitions("near")
    return together.mapInArrow(lean(run), "key long, total long, code double")


def _most(df: DataFrame, most: int, *columns: str) -> dict:
    """Columns, sorted by key, of up to ``most`` rows with the largest totals, all of one size or none."""
    level = F.floor(F.log2("total") * 16).cast("int")
    kept, least = 0, None
    for row in df.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if (kept := kept + row["count"]) > most:
            break
        least = row["level"]
    got = df.filter(level >= (1 << 30 if least is None else least)).select("key", *columns).toArrow().combine_chunks().sort_by("key")
    return {c: got.column(c).to_numpy() for c in ("key", *columns)}


def _found(head: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in the sorted ``head``, and whether it is there."""
    if not len(head):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    keys, inverse = np.unique(keys, return_inverse=True)  # sorted, they are found one next to the other
    at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
    return at[inverse], (head[at] == keys)[inverse]


def _per_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct keys: keys, texts, occurrences."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.empty(0, int)
    return keys[at], owner[at], np.diff(np.append(at, len(keys)))


def score(docs: DataFrame, out: Column, text_col: str = "text", frequent: int = FREQUENT, frequent_grams: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``out`` tells which rows are held out from training; a null text is an empty one, whose only
    token is its end. ``score`` is the log10 probability of the text's bytes, in their order;
    ``base_score`` that of its tokens by their counts alone. Repeated rows are rows of their own,
    in training too. Other columns are ignored. Without training texts all bytes are equally
    likely. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"), out.alias("held_out"), (~out).alias("training"))
    counted = written(count(own), "counts")
    tokens, grams = counted.filter("not gram"), written(code(counted), "ngrams")
    facts = tokens.agg(F.sum("known").alias("n"), F.count_if(F.col("known") > 0).alias("v")).first()
    train_tokens, different = int(facts["n"] or 0), int(facts["v"] or 0)
    most_grams = FREQUENT_GRAMS if frequent == FREQUENT else frequent
    head, head_grams = _most(tokens, frequent, "known"), _most(grams, most_grams if frequent_grams is None else frequent_grams, "code")
    shared = spark.sparkContext.broadcast((head, head_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_grams = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column("text")
            for a, b in shingles.slices(column):
                texts, n = column.slice(a, b - a), b - a
                tokens, bounds = _tokens(texts)
                size = np.diff(bounds)
                owner = np.repeat(np.arange(n), size)
                at, hit = _found(head["key"], tokens)
                known = head["known"][at[hit]]
                sums = [np.bincount(owner[hit], w, n).astype(float) for w in (np.log10(known + 1.0), known > 0)]
                rare = _per_text(tokens[~hit], owner[~hit])
                grams, sizes = _grams(texts)
                owner = np.repeat(np.arange(n), sizes)
                at, hit = _found(head_grams["key"], grams)
                sums.append(np.bincount(owner[hit], head_grams["code"][at[hit]], n).astype(float))
                lists = []
                for key, doc, m in (rare, _per_text(grams[~hit], owner[~hit])):
                    ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                    lists += [pa.ListArray.from_arrays(ends, pa.array(key)), pa.ListArray.from_arrays(ends, pa.array(m.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(number + np.arange(n)), pa.array(size), *map(pa.array, sums), *lists],
                    ["doc_id", "held_out", "row", "n_tokens", "seen_log", "seen_known", "seen_score", "rare", "times", "rare_grams", "gram_times"],
                )
                number += n

    kind = "doc_id long, held_out boolean, row long, n_tokens long, seen_log double, seen_known double, seen_score double, rare array<long>, times array<int>, rare_grams array<long>, gram_times array<int>"
    first = written(own.select("doc_id", "held_out", "text").mapInArrow(lean(run), kind), "texts-scored")

    def met(keys: str, times: str, table: DataFrame) -> DataFrame:
        rare = first.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("t")).select("row", "t.key", "t.times")
        # no key here is among the most frequent, so none is hot
        return rare.join(table.hint("shuffle_hash"), "key")

    zero = F.lit(0.0)
    by_token = met("rare", "times", tokens.select("key", "known")).select("row", (F.col("times") * F.log10(F.col("known") + 1)).alias("log"), F.when(F.col("known") > 0, F.col("times")).otherwise(0).alias("n"), zero.alias("score"))
    by_gram = met("rare_grams", "gram_times", grams.select("key", "code")).select("row", zero.alias("log"), F.lit(0).alias("n"), (F.col("times") * F.col("code")).alias("score"))
    sums = by_token.unionByName(by_gram).groupBy("row").agg(F.sum("log").alias("rare_log"), F.sum("n").alias("rare_known"), F.sum("score").alias("rare_score"))
    whole = float(np.log10(train_tokens + different + 1))
    return first.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("seen_log") + F.coalesce("rare_log", zero) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("seen_score") + F.coalesce("rare_score", zero)).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of documents, learned from those whose crc32(doc_id as text) mod 7 is not 2; a null id is never held out."""
    return score(docs, held_out(F.col("doc_id"), 7, 2))
