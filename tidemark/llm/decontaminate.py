"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item's windows are its runs of WINDOW words. A window occurs in a document
only if all its shingles do, so one of them, the necessary prefix, suffices to find it:
the rarest in the documents. Documents' shingles are joined with these few keys; a match
gives the window's place, which must lie within the document (length and position), and
the words there must be the window's, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, packed, unpacked, written

WINDOW = 10
SHINGLE = 5
# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which the benchmark's side is broadcast (about 200 bytes each); beyond, joins shuffle.
BROADCAST_WINDOWS = 250_000


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _key(own: Column, at: Column, size: int) -> Column:
    """Key of the shingle of ``size`` words that begins at word ``at``, counted from 0."""
    return F.xxhash64(F.lit(size), *(F.get(own, at + i) for i in range(size)))


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window, window_words, n, s: words of its shingles), and (window, item_id)."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("own")).filter(F.size("own") > 0)
    each = items.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("own") - WINDOW, F.lit(0))), lambda p: F.slice("own", p + 1, WINDOW))).alias("window_words"),
    ).withColumn("window", F.xxhash64(F.size("window_words"), F.array_join("window_words", " ")))
    each = written(each.distinct(), "benchmark-windows")
    n = F.size("window_words")
    own = each.select("window", "window_words").distinct().withColumn("n", n).withColumn("s", F.least(n, F.lit(SHINGLE)))
    return own, each.select("window", "item_id").distinct()


def _window_shingles(own: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every window: window, offset, key."""
    out = None
    for s in sizes:
        part = own.filter(F.col("s") == s).select("window", "window_words", F.explode(F.sequence(F.lit(0), F.col("n") - s)).alias("offset"))
        part = part.select("window", "offset", _key(F.col("window_words"), F.col("offset"), s).alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every document, with the document's columns: pos, key."""
    at = docs.select("*", F.posexplode("own").alias("pos", "_word"))
    keys = [F.when(F.col("pos") + s <= F.size("own"), _key(F.col("own"), F.col("pos"), s)) for s in sizes]
    if len(keys) == 1:
        return at.withColumn("key", keys[0]).filter("key is not null").drop("_word")
    return at.withColumn("key", F.explode(F.array(*keys))).filter("key is not null").drop("_word")


def _matched(docs: DataFrame, sizes: list[int], keys: DataFrame, small: bool) -> DataFrame:
    """The shingles of ``docs`` (doc_id, text_key, own) that have a row in ``keys``, with the columns of both.

    Where ``keys`` is too large to be broadcast, only ids, places and keys are shuffled, and the words are fetched for what matches.
    """
    at = _document_shingles(docs, sizes)
    if small:
        return at.join(F.broadcast(keys), "key")
    met = at.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "pos", "key").distinct().join(keys, "key")
    return docs.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).drop("_doc", "_key")


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (a hash of the text), n_words, n_hit, n_items,
    item_ids (sorted as strings) and contaminated.

    A null or empty text has no words. Items without words, and items with a null text or
    id, have no windows; a repeated item counts once. A repeated row of ``docs`` gets the
    same result again. Rows with a null doc_id are kept; those of equal text get the same
    result. An empty benchmark leaves all documents clean. Other columns are ignored.
    """
    own, items = windows(benchmark)
    sizes = sorted(r["s"] for r in own.select("s").distinct().collect())
    text = F.col(text_col)
    read = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), words(text).alias("own"))
    base = read.select("doc_id", "text_key", F.size("own").cast("long").alias("n_words"))
    if not sizes:
        none = F.lit(0).cast("long")
        return base.select("*", none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))
    small = own.count() <= BROADCAST_WINDOWS
    few = F.broadcast if small else (lambda df: df)
    shingles = written(_window_shingles(own, sizes), "benchmark-shingles")
    # how often the documents have each of the benchmark's shingles
    seen = _document_shingles(read, sizes).select("key").join(few(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("seen"))
    rarest = shingles.join(seen, "key", "left").groupBy("window").agg(F.min_by(F.struct("key", "offset"), F.struct(F.coalesce("seen", F.lit(0)), "offset")).alias("prefix"))
    prefix = written(rarest.select("window", "prefix.*").join(own, "window").select("window", "window_words", "n", "key", "offset"), "benchmark-prefixes")
    start = F.col("pos") - F.col("offset")
    hits = (
        _matched(read, sizes, prefix, small)
        .filter((start >= 0) & (start + F.col("n") <= F.size("own")))
        .filter(F.slice("own", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window_words"))
        .select("doc_id", "text_key", "window", start.alias("start"), (start + F.col("n")).alias("end"))
    )
    hits = written(hits, "benchmark-hits")
    doc = ["doc_id", "text_key"]
    spans = hits.groupBy(*doc, "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("before", F.coalesce(F.max("end").over(before), F.lit(0)))
    counts = covered.groupBy(*doc).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    listed = hits.select(*doc, "window").distinct().join(few(items), "window").groupBy(*doc).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = counts.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_key")
    same = (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.col("text_key") == F.col("_key"))
    out = base.join(found, same, "left").drop("_doc", "_key")
    listed = listed.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_key")
    out = out.join(listed, same, "left").drop("_doc", "_key")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        *doc,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def digests(marked: DataFrame) -> DataFrame:
    """The items' ids as a digest."""
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns, whatever their names.

    Null and empty texts stay. Every row is judged by its own text: of rows with one doc_id, or a
    null one, those that hold a window go and the others stay; repeated rows go or stay together.
    An empty benchmark leaves all rows.
    """
    bad = mark(docs, benchmark, text_col).filter("contaminated").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    own = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    left = own.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left_anti")
    return left.select(*unpacked("row", docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p + 1 : p + 10], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, s.n, array_to_string(w[p + 1 : p + s.n], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1)) AS p FROM d WHERE len(w) > 0), (SELECT DISTINCT n FROM bw) s
  WHERE p + s.n <= len(w)
), hit AS (
  SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), pos AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
