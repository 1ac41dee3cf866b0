"""Quality by nearest-neighbour voting over latent-semantic vectors.

The terms of a document are the shapes of its tokens (letters and case, digits, marks),
pairs of equal neighbours and lines seen before, so no language or topic is learned. A
latent space is fitted on a bounded sample of labelled documents; their vectors and labels
are broadcast, and every document is compared with all of them by exact cosine, in blocks.
The nearest vote with their similarity as the weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import _slices
from tidemark.llm.common import lean, written

#: Labelled documents that the space and the neighbours come from, at most.
SAMPLE = 4000
#: Terms of the space, its dimensions, neighbours that vote, and documents compared at once.
TERMS, DIMENSIONS, NEIGHBOURS, BLOCK = 512, 16, 25, 512
#: The power of the similarity that weighs a vote.
SHARPNESS = 16
#: Token shapes that a worker remembers, and the longest tokens of which it does.
REMEMBERED, REMEMBERED_SIZE = 100_000, 200
#: Symbols of a shape that are one term; a longer shape is as many terms as it has such pieces.
PIECE = 12

#: Runs of capitals, single capitals, other letters and digits; a run of capitals is kept apart from one by a control character.
_RUNS = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]{2,}", "\x01"), (r"[A-ZÀ-ÖØ-Þ]", "C"), (r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a"), (r"[0-9]+", "9"))]


class _Shapes(dict):
    def __missing__(self, token: str) -> str:
        shape = token
        for pattern, symbol in _RUNS:
            shape = pattern.sub(symbol, shape)
        shape = shape.replace("\x01", "U")
        if len(token) > REMEMBERED_SIZE:
            return shape
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = shape
        return shape


_SHAPES = _Shapes()


def terms(text: str | None) -> Counter:
    """Terms and counts of a whole text; a null or empty text has the one term ``<none>``."""
    tokens = (text or "").split()
    if not tokens:
        return Counter({"<none>": 1})
    out = Counter(map(_SHAPES.__getitem__, tokens))
    for shape in [s for s in out if len(s) > PIECE]:
        n = out.pop(shape)
        for i in range(0, len(shape), PIECE):
            out[shape[i : i + PIECE]] += n
    if same := sum(map(str.__eq__, tokens, tokens[1:])):
        out["<again>"] = same
    lines = text.split("\n")
    if again := len(lines) - len(set(lines)):
        out["<line again>"] = again
    out[f"<tokens {min(len(tokens), 4096).bit_length()}>"] = 1
    return out


class Space:
    """A latent-semantic space, and the labelled vectors in it.

    ``often`` has the space's terms and in how many of ``size`` documents each occurs.
    """

    def __init__(self, often: list[tuple[str, int]], size: int):
        self.terms = {t: i for i, (t, _) in enumerate(often)}
        self.idf = np.log1p(size / np.array([n for _, n in often] or [1.0]))

    def learn(self, rows: np.ndarray, labels: np.ndarray) -> Space:
        """The space with the labelled documents in it; ``rows`` as ``rows()`` gives them."""
        _, _, basis = np.linalg.svd(rows, full_matrices=False)
        self.basis = basis[:DIMENSIONS].T
        self.vectors = self._unit(rows @ self.basis)
        self.labels = np.array(labels, float)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        return self

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)

    def rows(self, bags: list[Counter]) -> np.ndarray:
        """Weights of the terms: the root of their share of the text, times their rarity."""
        out = np.zeros((len(bags), len(self.idf)))
        for i, bag in enumerate(bags):
            total = sum(bag.values())
            for t, n in bag.items():
                if (j := self.terms.get(t)) is not None:
                    out[i, j] = (n / total) ** 0.5
        return out * self.idf

    def scores(self, bags: list[Counter]) -> np.ndarray:
        """Share of label 1 among each document's nearest neighbours, weighted by similarity."""
        out = np.full(len(bags), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(bags) if k else 0, BLOCK):
            near = self._unit(self.rows(bags[start : start + BLOCK]) @ self.basis) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(near, best, 1), 0, 1).astype(float) ** SHARPNESS + 1e-6
            out[start : start + BLOCK] = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of up to ``most`` labelled documents, those with the smallest hash of their id.

    Only the ids chosen, at most ``most``, are broadcast; no text is shuffled.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", text_col: str = "text", most: int = SAMPLE) -> Space:
    """The space of a sample of at most ``most`` labelled documents for which ``train`` holds.

    The terms of the space, those in most of these documents, are counted in Spark; the driver gets
    them and then a row of TERMS numbers per document. A document that is learned from is
    read in the same way as one that is scored.
    """
    sample = written(labelled_sample(docs, labels, label, train, most, text_col), "quality-sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([[*terms(t)] for t in part.column("text").to_pylist()], pa.list_(pa.string()))], ["terms"])

    each = sample.select("text").mapInArrow(listed, "terms array<string>").select(F.explode("terms").alias("term"))
    often = each.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(TERMS).collect()
    shared = sample.sparkSession.sparkContext.broadcast(space := Space([(r["term"], r["n"]) for r in often], sample.count()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                found = shared.value.rows([terms(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([*found], pa.list_(pa.float64()))], ["doc_id", "label", "weights"])

    got = sample.select("doc_id", "label", "text").mapInArrow(rows, "doc_id long, label int, weights array<double>").toArrow().sort_by("doc_id")
    weights = got.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, len(often))
    return space.learn(weights, got.column("label").to_numpy())


def score(docs: DataFrame, space: Space, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` and ``out_col``: the weighted share of label 1 among the nearest neighbours, 0 to 1.

    Every row is scored on its own from its whole text; a null or empty text is compared as
    a text without tokens. Repeated rows get equal scores. Without labelled documents all
    get 0.5. Other columns pass through; one named ``out_col`` is an error.
    """
    if out_col in docs.columns:
        raise ValueError(f"the table already has a column {out_col}")
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text_col):
                scores = shared.value.scores([terms(t) for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, out_col])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from rows not held out.

    A null or empty text is compared as one without tokens; a null doc_id is never held out.
    Repeated rows get equal scores; labels other than 0 and 1, and null ones, are not learned from;
    of a repeated doc_id the largest label counts, and each of its texts is learned from. An empty
    table gives an empty result; other columns are ignored.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    space = fit(docs, labels, ~out, text_col=text_col)
    scored = score(docs.select("doc_id", F.col(text_col).alias("text")), space).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
