"""A store of books: what an upsert rewrites, what a read opens, and what is left of a failed write."""

import os

import pytest
from pyspark.sql import functions as F

from bookspark.operators.bookstore import BookStore

ROWS = "book_id string, topic_id int, topic string, version int"


def files(path):
    return {f for d, _, names in os.walk(f"{path}/data") for n in names if n.startswith("part-") and (f := os.path.join(d, n))}


def content(df):
    return {(r["book_id"], r["topic_id"], r["topic"], str(r["processed_at"])[:4]) for r in df.collect()}


def year(y):
    return F.lit(f"{y}-05-05 00:00:00")


def test_upserts_rewrite_touched_parts_only(spark, tmp_path):
    store = BookStore(spark, str(tmp_path / "s"), parts=8)
    first = [(f"b{b}", 10 * b + k, "old", 1) for b in range(30) for k in range(3)] + [(None, 999, "none", 1)]
    assert store.upsert(spark.createDataFrame(first, ROWS), "topic_id", "version", year(2020)) == 1
    before = files(store.path)
    updates = [("b3", 31, "late", 5), ("b3", 31, "later", 9), ("b3", 31, "early", 2), ("b3", 39, "new", 1)]
    assert store.upsert(spark.createDataFrame(updates, ROWS), "topic_id", "version", year(2021)) == 2
    after = files(store.path)
    assert before <= after
    touched = {f.split("store_version=2/")[1].split("/")[0] for f in after - before}
    assert len(touched) == 1  # one book, one part
    now = {p: v for p, v in store.manifest().items()}
    assert sorted(now.values()).count(2) == 1
    want = {(b, i, t, "2020") for b, i, t, _ in first if i != 31} | {("b3", 31, "later", "2021"), ("b3", 39, "new", "2021")}
    assert content(store.read()) == want
    assert content(store.book("b3")) == {r for r in want if r[0] == "b3"}
    assert content(store.read(1)) == {(b, i, t, "2020") for b, i, t, _ in first}
    assert store.upsert(spark.createDataFrame([], ROWS), "topic_id", "version") == 2


def test_a_book_is_read_by_partition(spark, tmp_path):
    store = BookStore(spark, str(tmp_path / "s"), parts=8)
    store.upsert(spark.createDataFrame([(f"b{k}", k, "t", 1) for k in range(40)], ROWS), "topic_id")
    plan = store.book("b7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(book_id,b7)" in plan
    assert len(store.book("b7").inputFiles()) <= 4 or store.book("b7").count() == 1


def test_readers_follow_the_manifest(spark, tmp_path):
    store = BookStore(spark, str(tmp_path / "s"), parts=2)
    assert store.read() is None and store.version() == 0
    with pytest.raises(LookupError):
        store.book("b")
    store.upsert(spark.createDataFrame([("b", 1, "t", 1)], ROWS), "topic_id")
    # files of a writer that was lost before its manifest are not read, and are overwritten
    spark.createDataFrame([("b", 1, "lost", 1)], ROWS).withColumn("processed_at", F.current_timestamp()).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{store.path}/data/store_version=2")
    assert [r["topic"] for r in store.read().collect()] == ["t"]
    store.upsert(spark.createDataFrame([("b", 1, "u", 1)], ROWS), "topic_id")
    assert [r["topic"] for r in store.read().collect()] == ["u"]
    with pytest.raises(RuntimeError):
        store._publish(2, {})
