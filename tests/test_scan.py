"""What came before each row, in parts, against one pass a group; and that the parts are even."""

import random

import pytest
from pyspark.sql import functions as F

from bookspark.operators import structure
from bookspark.plans.scan import scan


@pytest.mark.parametrize(("own", "parts"), [(True, 7), (False, 7), (False, 1)])
def test_scan_against_one_pass(spark, own, parts):
    rng = random.Random(parts)
    rows = [(g, k, rng.choice([None, None, None, rng.randint(1, 9)]), f"x{k}") for g, n in (("hot", 300), ("b", 20), ("c", 1), (None, 30)) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int, n string")
    got = {(r["g"], r["k"]): (r["n"], r["last"], r["total"]) for r in scan(df, "g", "k", {"last": F.col("v")}, {"total": F.col("v")}, own, parts).collect()}
    want, state = {}, {}
    for g, k, v, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last, total = state.get(g, (None, 0))
        after = (last if v is None else v, total + (v or 0))
        want[g, k] = (n, *(after if own else (last, total)))
        state[g] = after
    assert got == want
    assert scan(df.limit(0), "g", "k", {"last": F.col("v")}).count() == 0


def test_a_book_of_many_lines_lies_in_even_tasks(spark):
    n = 200_000
    lines = spark.range(n).select(F.lit("b").alias("book_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 1000 == 5, F.concat(F.lit("# h"), F.col("id").cast("string"))).otherwise("text").alias("line"), (F.col("id") / 10000).cast("int").alias("unit_no"))
    nodes = lines.where("line like '#%'").select("book_id", "line_no")
    marked = lines.join(nodes.withColumn("head", F.lit(True)), ["book_id", "line_no"], "left")
    out = scan(marked, "book_id", "line_no", {"node_line": F.when(F.col("head"), F.col("line_no"))}, parts=8)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and out.where("line_no >= 5 and node_line <> line_no - pmod(line_no - 5, 1000)").isEmpty() and out.where("node_line is null").count() == 5
    got = structure.map_by_position(lines, nodes).agg(F.count("*").alias("n"), F.sum((F.length("source_text") + 1) / 5).alias("m")).first()
    assert got["m"] == n - 5 - n // 1000 and got["n"] == n // 1000 + n // 10000 - 1
