"""A training corpus in five stages: reject toxic documents, drop recurring lines, keep one of each group of near
copies, mix sources to their target weights, and pack the mix into token sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup, mixing, near_dups, packing, toxicity
from sparkloom.llm.common import table, written

#: No SQL text can express the first stage's classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def recurring_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(line_dedup.dedup_lines(docs))


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.dedup(docs)


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(mixing.mix(docs))


def sequences_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", recurring_lines_go),
    ("MinHash near-dedup", one_of_each_group_stays),
    ("mixing", sources_are_mixed),
    ("packing", sequences_are_packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
