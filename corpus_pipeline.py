"""The corpus pipeline: stages that each read what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns documents; its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, pii, quality
from tidemark.llm.common import fresh, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null or empty text is judged as one without tokens; repeated rows stay or go together.
    """
    space = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id"), 4, 2))
    name = fresh(docs, "quality_score")
    return quality.score(docs, space, out_col=name).filter(F.col(name) >= 0.7).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked ones; of repeated rows one. Texts without words all stay."""
    return jaccard.dedupe(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars, where there is such a column, counts the new text (0 for null)."""
    out = pii.clean(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_tokens, and decodes: whether the ids, decoded, are the text's bytes again.

    A null or empty text has no tokens. A new column gets underscores before its name where the table has one of that name.
    """
    ids, count, decodes = (fresh(docs, name) for name in ("token_ids", "n_tokens", "decodes"))
    decoded = fresh(docs, "decoded")
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, out_col=ids, decoded_col=decoded)
    same = F.col(decoded) == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return encoded.withColumns({count: F.size(ids).cast("long"), decodes: same}).drop(decoded)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("tokens", tokenized),
]
#: The classifier and the tokenizer can't be expressed in SQL; the tests hold each stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
