"""Corpus pipeline: from raw documents to token files, one operator of ``phrasedex.llm`` per stage.

Each stage takes all documents its predecessor kept and, but for the last,
returns the columns of documents. Stages: language identification drops
documents in no learned language (or without letters); near-duplicates leave one
document of every group; documents that hold a passage of the benchmark go; the
sources are mixed to their target weights, a document as often as the mix takes it;
the rest is written as token files and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasedex.llm.common import ship_package, table
from phrasedex.llm.decontamination import remove_contaminated
from phrasedex.llm.language_id import held_out, keep_identified, train
from phrasedex.llm.mixing import emit_copies
from phrasedex.llm.near_duplicates import keep_one_each
from phrasedex.llm.token_files import token_file_digest
from phrasedex.session import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_identified(docs, train(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return emit_copies(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_file_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Language identification and near-duplicates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
