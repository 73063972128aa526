"""A corpus pipeline of five stages over `documents`, each written as Parquet and read by the next.

In every stage a null text counts as an empty one and stays, rows with a null doc_id stay, an empty table gives an empty
one, and columns beyond those of `documents` are carried along whatever their names, until the last stage replaces all. Of
rows that repeat a doc_id near-dedup keeps one. Stage outputs stand in a folder of their own below the shared one and are
left there for whoever reads the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, mixing, neardup, passages, toxicity
from marketloom.llm.session import shared_folder, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from the labelled documents that arrive."""
    labels = toxicity.one_label(table(spark, sf_dir, "labels"))
    lexicon = toxicity.learn(docs.select("doc_id", "text").join(labels, "doc_id"))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, lexicon, name=name).where(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return neardup.one_of_each(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return passages.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
