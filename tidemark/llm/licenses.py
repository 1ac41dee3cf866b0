"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

A template with n shingles is looked for in windows of 2 n shingles that begin every n / 2, so
every stretch of 1.5 n lies whole in one of them. A window that holds CONTAINED of a template's
shingles has a Jaccard similarity of at least 1/3 with it. Each of BANDS bands has one hash; a
window and a template collide in a band if their least values are equal, which all but two in a
million such pairs do in some band.

A band's least values are only equal where the window holds the shingle that is the template's
least. So documents' shingles are first joined with these few shingles, and only the windows
around a match are tested: the collisions are those of full signatures, at the cost of one
look-up per shingle. Windows that collide are verified exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import same, written
from tidemark.llm.decontaminate import _document_shingles, _key, _matched, words
from tidemark.llm.license_texts import TEMPLATES

BANDS = 32
#: Part of a template's shingles that a window must hold.
CONTAINED = 0.75
#: Words of a shingle, of templates below so many words and of longer ones: an edit in a short notice must leave most shingles whole.
SHORT, LONG, LONG_FROM = 3, 5, 40
#: Rows of templates' shingles up to which they are broadcast; beyond, joins shuffle.
BROADCAST_KEYS = 500_000


def templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, text string")


def _banded(key: Column, band: Column) -> Column:
    """The value of a shingle in a band."""
    return F.xxhash64(F.lit("band"), band, key)


def _sized_key(own: Column, at: Column, s: Column, sizes: list[int]) -> Column:
    """Key of the shingle of ``s`` words, one of ``sizes``, that begins at word ``at``."""
    return F.coalesce(*(F.when(s == size, _key(own, at, size)) for size in sizes))


def prepare(given: DataFrame) -> DataFrame:
    """(template, license_id, s, n, keys): each template's shingle size, number of shingles and distinct shingles."""
    own = given.filter("license_id is not null").select(F.col("license_id").cast("string").alias("license_id"), words(F.col("text")).alias("own")).filter(F.size("own") > 0).distinct()
    sizes = [*range(1, SHORT + 1), LONG]
    s = F.when(F.size("own") < LONG_FROM, F.least(F.size("own"), F.lit(SHORT))).otherwise(LONG)
    own = own.withColumn("s", s).withColumn("n", F.size("own") - F.col("s") + 1)
    keys = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _sized_key(F.col("own"), i, F.col("s"), sizes)))
    out = own.select(F.xxhash64("license_id", F.array_join("own", " ")).alias("template"), "license_id", "s", "n", keys.alias("keys"))
    return written(out, "license-templates")


def scan(docs: DataFrame, given: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), license_id, template, begin and end (first and last matched shingle) and containment of each match.

    A window matches if it holds CONTAINED of a template's shingles. Of matches of different
    licenses that lie on the same shingles (half of one's are the other's too), the one with the
    most shingles, less those it lacks, stays; ties all stay. Matches elsewhere in the text don't
    matter to it. Null and empty texts match nothing; templates without words or with a null id
    or text take no part, repeated ones count once. A repeated row of ``docs`` has its matches
    once; rows with a null doc_id are told apart by their text. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = prepare(templates(spark) if given is None else given)
    sizes = sorted(r["s"] for r in own.select("s").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], docs.select("doc_id").schema.add("text_key", "long").add("license_id", "string").add("template", "long").add("begin", "integer").add("end", "integer").add("containment", "double"))
    text = F.col(text_col)
    read = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), words(text).alias("own"))

    bands = own.select("template", "s", "n", "keys", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    least = bands.select("*", F.explode("keys").alias("key")).groupBy("template", "s", "n", "band").agg(F.min_by("key", _banded(F.col("key"), F.col("band"))).alias("key"))
    least = written(least.groupBy("key", "template", "s", "n").agg(F.collect_list("band").alias("bands")), "license-bands")
    keys = written(own.select("template", "license_id", F.size("keys").alias("of"), F.explode("keys").alias("key")), "license-keys")
    small = keys.count() <= BROADCAST_KEYS and least.count() <= BROADCAST_KEYS
    few = F.broadcast if small else (lambda df: df)

    met = _matched(read, sizes, least, small)
    step = F.ceil(F.col("n") / 2).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - 2 * F.col("n")) / step) + 1).cast("int")
    window = lambda i: F.struct((i * step).alias("window"), F.slice("own", i * step + 1, 2 * F.col("n") + F.col("s") - 1).alias("own"))
    # from here on a row has the words of its window only, not those of the whole text
    place = ["doc_id", "text_key", "template", "window"]
    met = met.select("doc_id", "text_key", "template", "s", "key", "bands", F.explode(F.transform(F.sequence(first, F.floor(F.col("pos") / step).cast("int")), window)).alias("w"))
    met = met.select(*place[:3], "s", "key", "bands", "w.window", "w.own")
    inside = F.sequence(F.lit(0), F.size("own") - F.col("s"))
    lower = lambda i, b: _banded(_sized_key(F.col("own"), i, F.col("s"), sizes), b) < _banded(F.col("key"), b)
    met = met.filter(F.exists("bands", lambda b: ~F.exists(inside, lambda i: lower(i, b))))
    # a text's windows are made in one task, so that they are reduced to one row each before the shuffle
    windows = met.select(*place, "own").groupBy(*place).agg(F.first("own").alias("own"))
    matched = _document_shingles(windows, sizes).join(few(keys), ["template", "key"])
    matched = written(matched.select(*place, "license_id", "of", "key", (F.col("window") + F.col("pos")).alias("pos")), "license-windows")

    per = matched.groupBy(*place, "license_id", "of").agg(F.count_distinct("key").alias("held"), F.count("*").alias("n"), F.min("pos").alias("begin"), F.max("pos").alias("end"))
    per = written(per.withColumn("containment", F.col("held") / F.col("of")).withColumn("score", 2 * F.col("held") - F.col("of")).filter(F.col("containment") >= CONTAINED), "license-verified")
    # what lies on each shingle of a text; windows of one license count once there, as the best of them decides
    on = matched.join(per.select(*place, "score", "n"), same(matched, per, place)).select(*(matched[c] for c in place), "license_id", "pos", "score", "n")
    on = written(on, "license-places")
    best = on.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("pos").alias("_pos"), F.col("license_id").alias("by")).agg(F.max("score").alias("best"))
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (F.col("pos") == F.col("_pos"))
    over = on.join(best, here & (F.col("license_id") != F.col("by")) & (F.col("best") > F.col("score")))
    beaten = over.groupBy(*place, "by").agg(F.count("*").alias("shared"), F.first("n").alias("n")).filter(2 * F.col("shared") >= F.col("n")).select(*place).distinct()
    return per.join(beaten, same(per, beaten, place), "left_anti").select("doc_id", "text_key", "license_id", "template", "begin", "end", "containment").distinct()


def label(docs: DataFrame, given: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_licenses, licenses (identifiers, sorted, comma-joined) and containment (the largest; null without a match) of every row.

    A null or empty text has no words and no license. Repeated rows get equal results, also with a
    null doc_id. An empty table gives an empty result; other columns are ignored.
    """
    matches = written(scan(docs, given, text_col), "license-matches")
    per = matches.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set("license_id")).alias("ids"), F.max("containment").alias("containment"))
    text = F.col(text_col)
    own = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text"), F.size(words(text)).cast("long").alias("n_words"))
    out = own.join(per, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.size(ids).cast("long").alias("n_licenses"), F.array_join(ids, ",").alias("licenses"), "containment")


def _sql() -> str:
    """The same result in SQL, without signatures: every shingle is joined with all templates', and every window is verified."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in TEMPLATES)
    split = lambda c: f"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH d AS (
  SELECT doc_id, {split('text')} AS w FROM documents
), g AS (
  SELECT DISTINCT license_id, {split('text')} AS w FROM (VALUES {rows}) v(license_id, text)
), t AS (
  SELECT license_id, array_to_string(w, ' ') AS template, w, CASE WHEN len(w) < {LONG_FROM} THEN least(len(w), {SHORT}) ELSE {LONG} END AS s FROM g
), tn AS (
  SELECT *, len(w) - s + 1 AS n, CAST(ceil((len(w) - s + 1) / 2.0) AS BIGINT) AS step FROM t
), tk AS (
  SELECT DISTINCT license_id, template, s, n, step, array_to_string(w[p + 1 : p + s], ' ') AS g FROM (SELECT *, unnest(generate_series(0, n - 1)) AS p FROM tn)
), tc AS (
  SELECT template, license_id, count(*) AS total FROM tk GROUP BY ALL
), dk AS (
  SELECT doc_id, p, s.s, array_to_string(w[p + 1 : p + s.s], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1)) AS p FROM d WHERE len(w) > 0), (SELECT DISTINCT s FROM tk) s WHERE p + s.s <= len(w)
), m AS (
  SELECT doc_id, template, license_id, p, dk.g, unnest(generate_series(greatest(0, CAST(floor((p - 2 * n) / CAST(step AS DOUBLE)) AS BIGINT) + 1), p // step)) * step AS win FROM dk JOIN tk ON dk.g = tk.g AND dk.s = tk.s
), per AS (
  SELECT doc_id, template, license_id, win, total, count(DISTINCT g) AS held, count(*) AS n FROM m JOIN tc USING (template, license_id) GROUP BY ALL HAVING count(DISTINCT g) >= {CONTAINED} * total
), o AS (
  SELECT m.doc_id, m.template, m.license_id, m.win, m.p, 2 * held - total AS score, per.n FROM m JOIN per USING (doc_id, template, license_id, win)
), best AS (
  SELECT doc_id, p, license_id, max(score) AS best FROM o GROUP BY ALL
), beaten AS (
  SELECT DISTINCT doc_id, template, license_id, win FROM (
    SELECT a.doc_id, a.template, a.license_id, a.win, b.license_id AS by_, count(*) AS shared, first(a.n) AS n FROM o a JOIN best b ON a.doc_id = b.doc_id AND a.p = b.p AND a.license_id <> b.license_id AND b.best > a.score GROUP BY ALL
  ) WHERE 2 * shared >= n
), kept AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses, count(DISTINCT license_id) AS n, max(held / CAST(total AS DOUBLE)) AS containment FROM per ANTI JOIN beaten USING (doc_id, template, license_id, win) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, containment FROM d LEFT JOIN kept USING (doc_id)
"""


ORACLE_SQL = _sql()
