"""What came before each row of an ordered group, when the group is larger than a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.session import cut


def scan(rows: DataFrame, group: str, order: str, lasts: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, own: bool = True, parts: int | None = None) -> DataFrame:
    """rows with, under the names of `lasts`, the last value that isn't null so far in the group, and under those of `sums` the sum so far, null counted as 0.

    With `own` a row's own value counts, without only those before it. Rows are
    dealt by range of (group, order) into even parts, whatever the sizes of the
    groups. Each part finds its own last values and sums, a group's parts before it are
    carried over, and the rest happens within the parts. Order is unique in a group.
    """
    lasts, sums = lasts or {}, sums or {}
    spark = rows.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    value = {n: c for n, c in (lasts | sums).items()}
    # the ranges are drawn by sampling, so the parts are written down once
    dealt = cut(rows.withColumns({f"__{n}": c for n, c in value.items()}).repartitionByRange(parts, group, order).withColumn("__part", F.spark_partition_id()))
    # a group that lies in one part needs nothing carried; of the others there are fewer than parts
    span = dealt.groupBy(group).agg(F.min("__part").alias("a"), F.max("__part").alias("b")).where("a < b").select(F.col(group).alias("__g"))
    same = F.col(group).eqNullSafe(F.col("__g"))
    totals = dealt.join(F.broadcast(span), same, "left_semi").groupBy(group, "__part").agg(
        *[F.max_by(F.col(f"__{n}"), F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(f"__{n}") for n in lasts], *[F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(f"__{n}") for n in sums], F.lit(1).alias("__one")
    )
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"), *[F.last(f"__{n}", True).over(earlier).alias(f"__c_{n}") for n in lasts], *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in sums]
    )
    both = dealt.join(F.broadcast(carried), same & (F.col("__part") == F.col("__p")), "left")
    here = Window.partitionBy("__part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = {n: F.coalesce(F.last(f"__{n}", True).over(here), F.col(f"__c_{n}")) for n in lasts}
    out |= {n: F.coalesce(F.sum(f"__{n}").over(here), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in value]
    return both.select(*kept, *[c.alias(n) for n, c in out.items()])
