"""A corpus pipeline of five stages over ``documents``: each calls one operator of ``lumaspark.llm`` on all that the stage before kept.

1. ``language_id``: drops documents without a letter and those whose language is ambiguous.
2. ``near_duplicates``: of each class of documents linked by a 5-gram similarity of 0.8 or more, the one with the least id stays.
3. ``decontaminate``: drops documents that hold a passage of ``benchmark`` within the edit budget.
4. ``mask_secrets``: replaces each secret by ``[secret]``, segment by segment, and counts the characters anew; every document stays.
5. ``mix``: weighs the documents to the source, language and topic targets and keeps those drawn, with the number of copies.

A null text has no letter and goes in the first stage; documents without an id pass the second. An empty table gives an empty result.
The columns of ``documents`` (``COLUMNS``) are carried; any other column of the input is left out, so none can clash. Texts are read whole by every stage, very
long ones too. In the second stage a single row of each id stays, and of the documents of one class the least id. Drawing depends on id and text alone, so equal rows are drawn alike. Each stage is a table in the shared folder, which is kept:
a stage can be run again from the one before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumaspark.llm import bayes_join, ecoc_language, mixing, pigeonhole, secrets
from lumaspark.llm.tasks import table
from lumaspark.session import stage_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = ecoc_language.held_out(F.col("doc_id"), 4, 2)
    found = ecoc_language.identify(docs.select(*COLUMNS), ecoc_language.train(docs.where(~held)))
    return found.where((F.col("lang_pred") != ecoc_language.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bayes_join.one_per_class(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pigeonhole.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = docs.select(*COLUMNS).withColumn("text", secrets.masked(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, "topic", "tokens", "weight", "expected", "copies")


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets), ("mix", mix),
]
ORACLE_SQL = None  # language, MinHash, edit distance and raking are not expressible in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{stage_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
