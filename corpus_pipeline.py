"""From raw documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import stage
from docquarry.llm.packing import pack_documents
from docquarry.llm.private import mask_private
from docquarry.llm.quality import keep_good
from docquarry.llm.similarity import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule of policy standard, version 1, rejects."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by 4-grams join."""
    return keep_one(docs)


#: Session setting with the secret key of the pseudonyms; without it the runs of tests and checks are repeatable.
KEY_SETTING = "spark.docquarry.pseudonyms.key"


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal numbers, dates and addresses; n_chars stays that of the source."""
    return mask_private(docs, spark.conf.get(KEY_SETTING, "no secret"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

#: SQL has no tokenizer; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the stage before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
