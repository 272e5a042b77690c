"""A training-data pipeline of five stages over ``documents``; each works on all that the one before has kept.

All stages read whole texts of any length, read only ``doc_id`` and ``text`` (and in training ``lang``), and hand on
every column; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, common, decontam, langid, minhash, toxicity

#: A document is toxic from this probability on.
TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (null, no letter, or far from every centroid) go. Repeated rows share their fate; rows with a
    null id or label are judged but never learned from."""
    model = langid.fit(docs.where(~langid.held_out()))
    return docs.where(~langid.predict(docs, model)["rejected"])


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least ``TOXIC`` go, ties at it included; null and empty texts have the base rate
    and stay while that is lower. Repeated rows share their fate."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.predict(docs, model)["toxic"] < TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on shingles of five words, the smallest id stays. Rows of one id and
    one text are one document, rows of one id and different texts are several; null and wordless texts stay."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of eight words with any benchmark item go; null and wordless texts stay. Repeated
    rows share their fate; an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, checked by decoding them again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for
    each document; a null text counts as empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("toxicity", detoxify), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", tokenize)]

#: SQL can express neither the classifiers nor the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
