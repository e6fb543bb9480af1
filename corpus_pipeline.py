"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes
each stage's rows as Parquet in the shared folder and rereads them for the
next. Near duplicates are found, and items looked up, over all rows that the
stage before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bookspark.llm import bpe, decontaminate, lines, quality, simhash
from bookspark.llm._shared import prepare, shared_dir, table
from bookspark.llm.queries import vocabulary_path

#: No SQL says the fuzzy lines, fingerprints and token ids of this pipeline; tests hold it against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that copy an earlier line go, and documents that had nothing else; n_chars follows the text."""
    from pyspark.sql import functions as F

    return lines.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text that these decode to."""
    from pyspark.sql import functions as F

    out = bpe.encode(docs, vocabulary_path(), decode=True)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality_rules(prepare(spark), docs, sf_dir)),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: near_dedup(prepare(spark), docs, sf_dir)),
    ("decontamination", lambda spark, docs, sf_dir: decontamination(prepare(spark), docs, sf_dir)),
    ("bpe", lambda spark, docs, sf_dir: bpe_round_trip(prepare(spark), docs, sf_dir)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each one's rows written and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
