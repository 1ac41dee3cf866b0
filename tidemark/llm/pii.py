"""Personal data by weak supervision, in DataFrame functions only.

Base kinds (email, ip, card, phone) come from fixed patterns and always stay. Further
candidates (secrets, other long numbers, local phone numbers) get votes from three kinds
of labelers: the shape of the span, a gazetteer, and the words before it. Votes are
counted over all documents per pattern of votes and features; expectation-maximisation
over these few counts estimates how reliable each labeler is, and a logistic span
classifier is trained on the counts with the estimated probabilities as its target. It
decides which candidates become spans.

Offsets count code points. Patterns are written so that no repeated group of varying
length occurs (a regex engine would recurse on it) and no start is tried within a run
that has failed already, so they take time linear in the text. For that, a dot between two
domain characters and a separator between two digits are first replaced by one private
character each, which keeps all offsets. Lists of spans are folded by appending, and
candidates compared with the spans before: time grows with the square of the spans of one
text (16,000 spans in 383 KB took 79 s).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import packed, unpacked, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "number", "secret")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

# Private code points that stand for a domain's dot and a number's separator, and the one that text holding them gets.
DOT, GAP, OTHER = "\ue001", "\ue002", "\ue003"
LOCAL, DOMAIN = "A-Za-z0-9._%+" + DOT + "-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{DOMAIN}]++{DOT}[{DOMAIN}{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = rf"[0-9][0-9{GAP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"[=:] {0,2}[\"']?[A-Za-z0-9_+/=.-]{16,}+[\"']?"
# The gazetteers and context words of the labelers.
KEY_NAMES = r"(?i)(token|secret|passw(or)?d|pwd|api[ _-]?key|access[ _-]?key|auth|bearer|credential)s?[\"' ]{0,3}$"
NUMBER_WORDS = r"(?i)\b(card|visa|mastercard|amex|account|acct|iban|ssn|social security|passport|tax|konto|karte|compte|carte|cuenta|tarjeta)\b"
PHONE_WORDS = r"(?i)\b(phone|tel|call|fax|mobile|cell|contact|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|35)"
#: Code points before a candidate that the context labelers read.
CONTEXT = 32


def _spans(gaps: Column, hits: Column) -> Column:
    """Start, end and text of each hit, from the pieces between hits (one more than hits)."""
    start = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hit", T.StringType())])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(start)).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, doubled(F.substring(digits, i, 1).cast("int"))).otherwise(F.substring(digits, i, 1).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _clear_of(taken: Column, span: Column) -> Column:
    return ~F.exists(taken, lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))


def found(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and, per row, the base spans ``pii_base`` and the candidates ``pii_candidates``
    (kind, start, end, shape, gazetteer, context, long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9][^0-9]{0,2}[0-9]")
    safe = F.translate(text, DOT + GAP, OTHER + OTHER)
    seen = {
        "email": (text.contains("@"), F.regexp_replace(safe, rf"(?<=[{DOMAIN}])\.(?=[{DOMAIN}])", DOT), EMAIL),
        "ip": (digit & text.contains("."), text, IP),
        "card": (digit, F.regexp_replace(safe, "(?<=[0-9])[ -](?=[0-9])", GAP), DIGITS),
        "phone": (text.contains("+"), text, PHONE),
        "local_phone": (digit, text, LOCAL_PHONE),
        "secret": (text.contains("=") | text.contains(":"), text, SECRET),
    }
    out = df
    for kind, (worth, source, _) in seen.items():
        out = out.withColumn(f"_{kind}", F.when(worth, source))
    for kind, (_, _, pattern) in seen.items():
        own = F.col(f"_{kind}")
        out = out.withColumn(f"_{kind}_hits", F.when(own.isNotNull(), F.regexp_extract_all(own, F.lit(pattern), F.lit(0))))
    for kind, (_, _, pattern) in seen.items():
        own, hits = F.col(f"_{kind}"), F.col(f"_{kind}_hits")
        none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
        out = out.withColumn(f"_{kind}_all", F.when(F.size(hits) > 0, _spans(F.split(own, pattern, -1), hits)).otherwise(none))
    part = lambda s, i: F.split(s["hit"], r"\.")[i].try_cast("double") <= 255
    count = lambda s: F.length(_digits(s["hit"]))
    kept = {
        "email": F.col("_email_all"),
        "ip": F.filter("_ip_all", lambda s: part(s, 0) & part(s, 1) & part(s, 2) & part(s, 3)),
        "card": F.filter("_card_all", lambda s: F.when(count(s).between(13, 19), _luhn(_digits(s["hit"]))).otherwise(False)),
        "phone": F.filter("_phone_all", lambda s: count(s).between(9, 15)),
    }
    named = lambda kind, spans: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = out.withColumn("pii_base", F.concat(*(named(kind, kept[kind]) for kind in BASE)))

    before = lambda s: F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"]))

    def candidate(kind: str, s: Column, shape: Column, gazetteer: Column, context: Column, long: Column, start: Column | None = None) -> Column:
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return F.struct(F.lit(kind).alias("kind"), (s["start"] if start is None else start).alias("start"), s["end"].alias("end"), flag(shape).alias("shape"), flag(gazetteer).alias("gazetteer"), flag(context).alias("context"), flag(long).alias("long"))

    lead = lambda s: F.length(F.regexp_extract(s["hit"], "^[=:] *", 0))
    value = lambda s: F.regexp_replace(s["hit"], "^[=:] *|[\"']", "")
    local = F.transform("_local_phone_all", lambda s: candidate("local_phone", s, s["hit"].startswith("("), ~F.substring(_digits(s["hit"]), 1, 1).isin("0", "1"), before(s).rlike(PHONE_WORDS), F.lit(False)))
    number = F.transform(
        F.filter("_card_all", lambda s: count(s).between(9, 24)),
        lambda s: candidate("number", s, count(s).between(13, 19) | s["hit"].rlike(f"^[0-9]{{3}}{GAP}[0-9]{{2}}{GAP}[0-9]{{4}}$"), _digits(s["hit"]).rlike(ISSUERS), before(s).rlike(NUMBER_WORDS), count(s) >= 13),
    )
    secret = F.transform("_secret_all", lambda s: candidate("secret", s, value(s).rlike("^[0-9a-fA-F]{32,}$|^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).{20,}$"), before(s).rlike(KEY_NAMES), s["hit"].rlike("^= *[\"']"), F.length(value(s)) >= 24, s["start"] + lead(s)))
    out = out.withColumn("_candidates", F.concat(local, number, secret))
    out = out.withColumn("pii_candidates", F.filter("_candidates", lambda s: _clear_of(F.col("pii_base"), s)))
    return out.drop("_candidates", *(f"_{kind}{end}" for kind in seen for end in ("", "_hits", "_all")))


FEATURES = ("shape", "gazetteer", "context", "long")
LABELERS = FEATURES[:3]
#: Rounds of expectation-maximisation and steps of the classifier's gradient descent.
ROUNDS, STEPS = 60, 400


def estimate(counts: list[dict]) -> list[float]:
    """Probability that candidates with each row's votes are personal data.

    ``counts``: the votes and ``n``. Each labeler has a hit rate for true and for false
    candidates; they start at 0.8 and 0.2, with two pseudo-observations each.
    """
    hit = {c: {f: 0.8 if c else 0.2 for f in LABELERS} for c in (0, 1)}
    prior, post = 0.5, [0.5] * len(counts)
    for _ in range(ROUNDS):
        for i, row in enumerate(counts):
            like = {c: math.prod(hit[c][f] if row[f] else 1 - hit[c][f] for f in LABELERS) * (prior if c else 1 - prior) for c in (0, 1)}
            post[i] = like[1] / (like[0] + like[1])
        for c in (0, 1):
            weight = [row["n"] * (p if c else 1 - p) for row, p in zip(counts, post, strict=True)]
            for f in LABELERS:
                base = 0.8 if c else 0.2
                hit[c][f] = (sum(w for w, row in zip(weight, counts, strict=True) if row[f]) + 2 * base) / (sum(weight) + 2)
        prior = (sum(row["n"] * p for row, p in zip(counts, post, strict=True)) + 1) / (sum(row["n"] for row in counts) + 2)
    return post


def train(counts: list[dict]) -> dict[str, list[float]]:
    """Per kind, the logistic classifier's weights of FEATURES and its intercept."""
    out = {}
    for kind in ADDED:
        rows = [r for r in counts if r["kind"] == kind]
        weights, total = [0.0] * (len(FEATURES) + 1), sum(r["n"] for r in rows)
        inputs = [[float(r[f]) for f in FEATURES] + [1.0] for r in rows]
        target = estimate(rows)
        for _ in range(STEPS if rows else 0):
            slope = [0.0] * len(weights)
            for r, x, y in zip(rows, inputs, target, strict=True):
                p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True))))
                for j, v in enumerate(x):
                    slope[j] += r["n"] / total * (p - y) * v
            weights = [w - 1.0 * (s + 1e-3 * w) for w, s in zip(weights, slope, strict=True)]
        out[kind] = weights
    return out


def _weights(candidates: DataFrame) -> dict[str, list[float]]:
    """The classifier, from the votes that all candidates got; 3 kinds and 4 yes-or-no features are at most 48 rows, whatever the input."""
    counts = candidates.select(F.explode("pii_candidates").alias("c")).select("c.kind", *(f"c.{f}" for f in FEATURES)).groupBy("kind", *FEATURES).agg(F.count("*").alias("n"))
    return train([r.asDict() for r in counts.orderBy("kind", *FEATURES).collect()])


def _accepted(weights: dict[str, list[float]]) -> Column:
    """The base spans and the candidates that the classifier accepts, none overlapping one before it."""

    def fine(c: Column) -> Column:
        score = lambda kind: reduce(lambda a, b: a + b, [c[f] * w for f, w in zip(FEATURES, weights[kind], strict=False)]) + weights[kind][-1]
        return F.coalesce(*(F.when(c["kind"] == kind, score(kind) >= 0) for kind in ADDED))

    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    chosen = F.transform(F.filter("pii_candidates", fine), plain)
    disjoint = F.aggregate(chosen, F.array().cast(T.ArrayType(SPAN)), lambda acc, s: F.when(_clear_of(acc, s), F.array_append(acc, s)).otherwise(acc))
    return F.concat("pii_base", disjoint)


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``pii_spans`` (kind, start, end): all personal data of each whole text.

    Base spans come first, by kind and start, then those that the classifier accepts;
    these overlap neither base spans nor one another. A null or empty text has none.
    Rows are independent: repeated rows get equal spans, other columns play no part, an
    empty table stays empty.
    """
    own = docs.select(packed(docs.select(*keep)).alias("row"), F.col(text_col).alias("text"))
    rows = written(found(own, "text").select("row", "pii_base", "pii_candidates"), "pii-candidates")
    return rows.select(*unpacked("row", keep), _accepted(_weights(rows)).alias("pii_spans"))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all personal data of each text replaced, as ``find`` finds and ``redact`` replaces it.

    The texts are read twice, once for the votes and once to be written, and never shuffled.
    All rows and columns stay, whatever their names; a null text stays null, an empty one empty.
    Repeated rows get equal texts; an empty table stays empty.
    """
    seen = found(docs.select(packed(docs).alias("row"), F.col(text_col).alias("text")), "text")
    spans = seen.withColumn("pii_spans", _accepted(_weights(seen.select("pii_candidates"))))
    return redact(spans, "text").select(*unpacked("row", docs.columns, **{text_col: F.col("text")}))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, and all spans as text."""
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(count(kind) for kind in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``df`` with ``[KIND]`` in place of each span of the text. Overlapping spans become one, under the name of the first. A null text stays null."""
    text = F.col(text_col)
    order = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, 1 << 30))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, F.aggregate(order, empty, step, rest)).otherwise(text))
