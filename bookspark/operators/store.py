"""Books and topics as tables: upserts and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, updates: DataFrame, key: str, version: str = "version") -> DataFrame:
    """table with updates by key: the row of the highest version wins as a whole, an update before a stored row.

    Rows of one key are reduced before they are shuffled.
    """
    fields = [c for c in table.columns if c != key]
    both = table.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*fields), F.struct("__new", version))
    return both.groupBy(key).agg(last.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in fields])


def book_by_id(books: DataFrame, book_id: str | Column) -> DataFrame:
    return books.where(F.col("book_id") == book_id)


def topics_by_book(topics: DataFrame, book_id: str | Column) -> DataFrame:
    """A book's topics with their place in it."""
    return topics.where(F.col("book_id") == book_id).orderBy("ins_seq")


def decode_topics(topics: DataFrame) -> DataFrame:
    """metadata JSON as a variant; null where it is not JSON."""
    return topics.withColumn("metadata", F.try_parse_json("metadata"))
