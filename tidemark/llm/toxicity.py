"""Toxicity by a weighted finite-state pattern grammar.

Five letter-to-letter transducers rewrite the symbols of a clause one after another: reported
speech and negation weaken what they cover, target finds who is meant, threat asks for a target,
insult marks what counts. Their arcs carry factors; composed, they are one machine, and a clause
weighs what its best path does: the lexical weight of each marked word times the factors of its
arcs. So matched clauses are scored, not single words. The insult words and word beginnings are
learned with their weights from a bounded sample of labelled documents (beginnings, as languages
differ in how they build words); a logistic model turns a document's clause scores into a
probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import _slices
from tidemark.llm.common import lean, written
from tidemark.llm.quality import held_out, labelled_sample

#: Labelled documents that the lexicon and the model are learned from, at most.
SAMPLE = 8000
#: Learned entries at most, documents that one must occur in, and the least log-odds weight.
ENTRIES, LEAST_DOCUMENTS, LEAST_WEIGHT = 2000, 4, 2.0
#: Lengths of the word beginnings that are learned; whole words (of two letters at least) end in a space.
SHORTEST, LONGEST = 4, 9
#: Words between two symbols of a pattern at most.
REACH = 4
# What the transducers besides the learned lexicon accept.
THREATS = "kill hurt destroy burn beat shoot stab punish crush smash töten schlagen tuer frapper matar golpear".split()
WILLS = "will shall gonna going i'll we'll werde werden vais allons voy vamos".split()
TARGETS = "you your yours u he she they them him her his these those du dich dir ihr euch tu te toi vous ton votre usted tú ti vosotros".split()
NEGATIONS = "not no never neither nor isn't aren't don't doesn't won't wouldn't nicht kein keine nie ne pas jamais nunca jamás sin".split()
CONTRASTS = "but yet however aber sondern doch mais pourtant pero sino".split()
REPORTS = "said says say wrote writes quoted called calls claimed reported stated sagte schrieb sagt dit écrit dijo escribió".split()
THREAT_WEIGHT, TARGET_FACTOR, WILL_FACTOR, AGAIN_FACTOR, NEGATION_FACTOR, REPORT_FACTOR = 2.0, 1.3, 1.5, 1.1, 0.5, 0.6

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Symbols of words: insult, threat, will, target, negation, contrast, report, any other.
SYMBOLS = "IHMTNBRO"


class Transducer:
    """States and arcs: (state, symbol read) -> (next state, symbol written, factor) of each choice; a clause may end in the final states."""

    def __init__(self, start, arcs: dict, final: set):
        self.start, self.arcs, self.final = start, arcs, final


def _made(start, states: list, symbols: str, choices, final) -> Transducer:
    return Transducer(start, {(q, s): tuple(found) for q in states for s in symbols if (found := choices(q, s))}, set(final))


def reported() -> Transducer:
    """What follows a verb of saying, to the end of the clause, is someone else's."""
    return _made(0, [0, 1], SYMBOLS, lambda q, s: [(1, "O", 1.0)] if s == "R" else [(q, s, REPORT_FACTOR if q and s in "IH" else 1.0)], [0, 1])


def negation() -> Transducer:
    """The words after a negation, up to a contrast, are denied. A state counts the words that are left."""

    def choices(q, s):
        if s in "NB":
            return [(REACH if s == "N" else 0, "O", 1.0)]
        return [(max(q - 1, 0), s, NEGATION_FACTOR if q and s in "IH" else 1.0)]

    return _made(0, [*range(REACH + 1)], SYMBOLS.replace("R", ""), choices, range(REACH + 1))


def target() -> Transducer:
    """Insults (A) and threats (K) with a target near. State 0: none near; k: one has gone by, which reaches k words further; -k: one is promised within k words."""

    def choices(q, s):
        if s == "T":
            return [(REACH, "O", 1.0)]
        rest = q - 1 if q > 0 else q + 1 if q < -1 else 0
        aimed = {"I": "A", "H": "K"}.get(s)
        if q == -1:
            return []  # the promise was not kept
        if not aimed:
            return [(rest, s, 1.0)]
        if q:
            return [(rest, aimed, TARGET_FACTOR)]
        return [(0, s, 1.0), (-REACH, aimed, TARGET_FACTOR)]

    return _made(0, [*range(-REACH, REACH + 1)], "IHMTO", choices, range(REACH + 1))


def threat() -> Transducer:
    """A threat counts (X) only with a target, and more after a word of will. A state counts the words since that one."""

    def choices(q, s):
        if s == "M":
            return [(REACH, "O", 1.0)]
        rest = max(q - 1, 0)
        if s in "HK":
            return [(rest, "X" if s == "K" else "O", WILL_FACTOR if q and s == "K" else 1.0)]
        return [(rest, s, 1.0)]

    return _made(0, [*range(REACH + 1)], "AIHKMO", choices, range(REACH + 1))


def insult() -> Transducer:
    """Marks (E) insults and threats; those after the first of a clause count more."""
    return _made(0, [0, 1], "AIXO", lambda q, s: [(q, "O", 1.0)] if s == "O" else [(1, "E", AGAIN_FACTOR if q else 1.0)], [0, 1])


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and writes what ``second`` makes of what that writes; factors multiply."""
    start = (first.start, second.start)
    arcs, left, known = {}, [start], {start}
    while left:
        p, q = state = left.pop()
        for (from_, symbol), choices in first.arcs.items():
            if from_ != p:
                continue
            found = tuple(((p2, q2), out, f * g) for p2, middle, f in choices for q2, out, g in second.arcs.get((q, middle), ()))
            if found:
                arcs[state, symbol] = found
                new = {to for to, _, _ in found} - known
                known |= new
                left.extend(new)
    return Transducer(start, arcs, {s for s in known if s[0] in first.final and s[1] in second.final})


PARTS = (reported, negation, target, threat, insult)


@lru_cache(maxsize=1)
def machine() -> Transducer:
    """All five as one, its states numbered."""
    whole = reduce(composed, [part() for part in PARTS])
    number = {s: i for i, s in enumerate(sorted({s for s, _ in whole.arcs} | whole.final, key=repr))}
    return Transducer(number[whole.start], {(number[s], a): tuple((number[t], out, f) for t, out, f in c if t in number) for (s, a), c in whole.arcs.items()}, {number[s] for s in whole.final})


class Grammar:
    """The symbols and weights of words, and the composed machine that weighs a clause of them."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words = {w[:-1]: v for w, v in lexicon.items() if w.endswith(" ")}
        self.stems = {w: v for w, v in lexicon.items() if not w.endswith(" ")}
        self.symbols = {w: s for s, group in (("R", REPORTS), ("B", CONTRASTS), ("N", NEGATIONS), ("T", TARGETS), ("M", WILLS), ("H", THREATS)) for w in group}
        self.read = _Read(self)

    def __reduce__(self):
        return Grammar, (self.lexicon,)

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's symbol and weight; I for an insult, O for any other word."""
        found = [self.words[word]] if word in self.words else []
        found += [self.stems[word[:n]] for n in range(SHORTEST, min(LONGEST, len(word)) + 1) if word[:n] in self.stems]
        if found:
            return "I", max(found)
        symbol = self.symbols.get(word, "O")
        return symbol, THREAT_WEIGHT if symbol == "H" else 0.0

    @staticmethod
    def clause(symbols: list[tuple[str, float]]) -> float:
        """Weight of a clause: that of the best path through the machine."""
        own, plain = machine(), 0
        alive = {own.start: 0.0}
        for symbol, weight in symbols:
            # after so many other words each part is at rest, and more of them change nothing
            plain = plain + 1 if symbol == "O" else 0
            if plain > REACH + 1:
                continue
            after: dict[int, float] = {}
            for state, total in alive.items():
                for to, out, factor in own.arcs.get((state, symbol), ()):
                    value = total + weight * factor if out == "E" else total
                    if value > after.get(to, -1.0):
                        after[to] = value
            alive = after
        return max(v for state, v in alive.items() if state in own.final)

    def features(self, text: str | None) -> list[float]:
        """Of a whole text: the sum and the largest of its clauses' weights, matched clauses, words (as logarithms), and the weight per root of a word."""
        total = most = 0.0
        matched = words = 0
        for part in CLAUSE.split(normal(text)):
            found = WORD.findall(part)
            words += len(found)
            symbols = [*map(self.read.__getitem__, found)]
            if any(map(_WEIGHT, symbols)):
                weight = self.clause(symbols)
                total, most, matched = total + weight, max(most, weight), matched + (weight > 0)
        return [np.log1p(total), np.log1p(most), np.log1p(matched), np.log1p(words), total / (1 + words) ** 0.5]


def _WEIGHT(symbol: tuple[str, float]) -> float:
    return symbol[1]


def normal(text: str | None) -> str:
    """Lower case, letters and their marks as one character where there is one."""
    return unicodedata.normalize("NFC", (text or "").lower())


def entries(text: str | None) -> set[str]:
    """What of a text may become an entry of the lexicon: its words and their beginnings."""
    words = {w for w in WORD.findall(normal(text)) if len(w) > 1}
    return {f"{w} " for w in words} | {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


class _Read(dict):
    def __init__(self, grammar: Grammar):
        super().__init__()
        self.grammar = grammar

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) >= 100_000:
            self.clear()
        out = self[word] = self.grammar.symbol(word)
        return out


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log-odds weight of the words and word beginnings that mark label 1 in ``sample`` (label, text).

    Documents are counted in Spark; at most ENTRIES entries come to the driver. A longer
    entry that adds nothing to a shorter beginning of its own is left out.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([sorted(entries(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))], ["label", "keys"])

    each = sample.select("label", "text").mapInArrow(listed, "label int, keys array<string>").select("label", F.explode("keys").alias("key"))
    counts = each.groupBy("key").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).filter(F.col("toxic") >= LEAST_DOCUMENTS)
    totals = sample.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    toxic, clean = totals["toxic"] or 0, totals["clean"] or 0
    odds = lambda n, of: F.log((n + 0.5) / (F.lit(of) - n + 0.5))
    weighed = counts.withColumn("weight", odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)).filter(F.col("weight") >= LEAST_WEIGHT)
    rows = weighed.orderBy(F.desc("weight"), F.desc("toxic"), "key").limit(ENTRIES).collect()
    found = {r["key"]: float(r["weight"]) for r in rows}
    covers = lambda key: any(found.get(key[:n], -1) >= found[key] - 0.5 for n in range(SHORTEST, len(key)))
    return {key: weight for key, weight in found.items() if not covers(key)}


class Model:
    """The grammar and the logistic model over its features."""

    def __init__(self, grammar: Grammar, rows: np.ndarray, labels: np.ndarray):
        self.grammar = grammar
        self.mean = rows.mean(0) if len(rows) else np.zeros(5)
        self.scale = rows.std(0) + 1e-9 if len(rows) else np.ones(5)
        self.weights = np.zeros(6)
        x, y = self.inputs(rows), labels
        for _ in range(50 if len(rows) else 0):  # Newton steps with a light ridge
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (p - y) + 0.5 * self.weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(6)
            self.weights = self.weights - np.linalg.solve(curve, slope)

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([(rows - self.mean) / self.scale, np.ones((len(rows), 1))])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = np.array([self.grammar.features(t) for t in texts], float).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(self.inputs(rows) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", text_col: str = "text", most: int = SAMPLE) -> Model:
    """Grammar and model from at most ``most`` labelled documents for which ``train`` holds.

    The driver gets the lexicon and five numbers for each of these documents.
    """
    sample = written(labelled_sample(docs, labels, label, train, most, text_col), "toxicity-sample")
    grammar = Grammar(learn_lexicon(sample))
    shared = sample.sparkSession.sparkContext.broadcast(grammar)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                rows = [[float(v) for v in shared.value.features(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "features"])

    got = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, features array<double>").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["features"]))
    return Model(grammar, np.array([r["features"] for r in got]).reshape(-1, 5), np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` and ``out_col``: the probability that the whole text is toxic.

    Every row is scored on its own. A null or empty text has no clauses. Repeated rows get
    equal scores. Without labelled documents all get 0.5. Other columns pass through; one
    named ``out_col`` is an error.
    """
    if out_col in docs.columns:
        raise ValueError(f"the table already has a column {out_col}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(text_col).to_pylist()))], [*part.schema.names, out_col])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from rows not held out.

    A null or empty text has no clauses; a null doc_id is never held out. Repeated rows get equal
    scores; labels other than 0 and 1, and null ones, are not learned from; of a repeated doc_id the
    largest label counts. An empty table gives an empty result; other columns are ignored.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, labels, ~out, text_col=text_col)
    scored = score(docs.select("doc_id", F.col(text_col).alias("text")), model).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
