"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, centroids, decontaminate, jaccard, licenses, lm, mixing, periodic, pii, quality, sharding, toxicity
from tidemark.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), queries=lambda vec_id: vec_id % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, ranks, pattern, decoded_col="decoded"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {"op1_ann": op1_ann, "op2_decontamination": op2_decontamination, "op3_byte_bpe": op3_byte_bpe, "op4_ppm": op4_ppm, "op5_licenses": op5_licenses, "op6_pii": op6_pii, "op7_sharding": op7_sharding, "op8_quality": op8_quality, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_toxicity": op10_toxicity, "op11_periodic_runs": op11_periodic_runs, "op12_centroids": op12_centroids, "op13_mixing": op13_mixing}


def oracle_sql() -> dict:
    return {"op2_decontamination": decontaminate.ORACLE_SQL, "op5_licenses": licenses.ORACLE_SQL, "op9_ngram_jaccard": jaccard.ORACLE_SQL, "op11_periodic_runs": periodic.ORACLE_SQL, "op12_centroids": centroids.ORACLE_SQL, "op13_mixing": mixing.ORACLE_SQL}
