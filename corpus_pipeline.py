"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and
returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import decontaminate, mixing, neardup, quality, tokens
from kinlink.llm.common import scratch, shared_dir, table
from kinlink.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, count and checksum of each document's ids, from the written token files."""
    return tokens.read_tokens(tokens.write_tokens(docs, tokenizer_path()))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing_sources", mixing_sources), ("token_ids", token_ids)]
#: Token ids can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with scratch():  # what a stage has staged goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
