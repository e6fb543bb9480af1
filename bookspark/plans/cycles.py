"""Edges without cycles, and strongly connected components."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.session import cut, importable

#: Edges that one task takes at most; groups with more are halved by Spark first.
LARGEST = 100_000


def strong_components(edges: DataFrame) -> DataFrame:
    """(u, v) of any one orderable type -> (node, label) of the nodes that lie on a cycle; label is the smallest node of their component.

    Nodes without an edge in or an edge out are trimmed away. Then the smallest
    node that reaches a node colours it, and the nodes of a colour that reach its
    namesake are a component; they and the edges between colours go, until no
    edge is left. Rounds grow with the length of the shortest ways, edges alone are shuffled.
    """
    found = None
    now = _trimmed(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    while not now.isEmpty():
        nodes = now.select(F.col("u").alias("node")).distinct()
        colour = _spread(nodes.withColumn("c", F.col("node")), now)
        same = cut(now.join(colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v"))
        # against the edges, from each colour's namesake
        home = colour.where("node = c").select("node", F.lit(True).alias("home"))
        reaching = _reaching(home.select("node"), same)
        own = cut(colour.join(reaching, "node", "left_semi").select("node", F.col("c").alias("label")))
        found = own if found is None else found.unionAll(own)
        left = same.join(own.select(F.col("node").alias("u")), "u", "left_anti").join(own.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v")
        now = _trimmed(left)
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    # components of two nodes or more
    sizes = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return found.join(sizes, "label", "left_semi").select("node", "label")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have an edge in and an edge out, again and again."""
    now, count = cut(edges), None
    while (was := count) != (count := now.count()) and count:
        both = now.select(F.col("u").alias("node")).intersect(now.select(F.col("v").alias("node")))
        now = cut(now.join(both.select(F.col("node").alias("u")), "u", "left_semi").join(both.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v"))
    return now


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c): the smallest c of the nodes that reach a node; only nodes that have changed tell others."""
    colour, news = cut(colour), None
    while news is None or not news.isEmpty():
        told = edges.join((colour if news is None else news).select(F.col("node").alias("u"), "c"), "u").groupBy(F.col("v").alias("node")).agg(F.min("c").alias("t"))
        both = cut(colour.join(told, "node", "left"))
        news = both.where("t < c").select("node", F.col("t").alias("c"))
        colour = both.select("node", F.least("c", "t").alias("c"))
    return colour


def _reaching(goals: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the goals and the nodes that reach one."""
    known = news = cut(goals)
    while not news.isEmpty():
        news = cut(edges.join(news.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("u").alias("node")).distinct().join(known, "node", "left_anti"))
        known = known.unionAll(news)
    return known


def acyclic(edges: DataFrame, order: Column, group: str = "book_id", src: str = "src", dst: str = "dst", largest: int = LARGEST) -> DataFrame:
    """edges without those that earlier edges of their group already lead back from: what is left has no cycle.

    An edge goes if a way of edges before it, by `order`, leads from its dst to
    its src. So the latest edge of each cycle goes and edges between components stay. Loops
    go; edges with a null end stay. Repeated edges stay or go one by one.

    Whether an edge closes a way depends on the strong components of the edges up to
    it. Groups are halved by order: edges inside a component of the earlier half
    go left, or go for good if they are later; the others go right, with each
    component as one node. Pieces of at most `largest` edges are done in one task each.
    """
    names = edges.columns
    # one number for the order of all edges: a sort by range, no window over a group
    numbered = cut(edges.orderBy(order).withColumn("__t", F.monotonically_increasing_id()))
    piece = F.sha2(F.coalesce(F.col(group).cast("string"), F.lit("")), 256) if group else F.lit("")
    work = cut(numbered.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(piece.alias("piece"), F.col(src).cast("string").alias("u"), F.col(dst).cast("string").alias("v"), F.col("__t").alias("t"), F.lit(-1).cast("long").alias("low")))
    gone = None
    while True:
        sizes = work.groupBy("piece").agg(F.count("*").alias("n"))
        many = sizes.where(F.col("n") > largest).select("piece")
        small = work.join(many, "piece", "left_anti")
        own = cut(_closed(small, largest))
        gone = own if gone is None else gone.unionAll(own)
        work = cut(work.join(many, "piece", "left_semi"))
        if work.isEmpty():
            break
        work, later = _halved(work)
        gone = gone.unionAll(later)
    return numbered.join(gone.select(F.col("t").alias("__t")), "__t", "left_anti").select(*[F.col(f"`{c}`") for c in names])


def _halved(work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, edges that go) after one step of all pieces; `low` is the time up to which a piece's edges are decided."""
    new = work.where("t > low").groupBy("piece").agg(F.count("*").alias("n"), F.percentile_approx("t", F.lit(0.5), F.lit(10_000)).alias("middle"))
    work = cut(work.join(new, "piece"))
    node = lambda c: F.struct("piece", F.col(c).alias("x"))
    early = work.where("t <= middle").select(node("u").alias("u"), node("v").alias("v"))
    label = cut(strong_components(early).select(F.col("node.piece").alias("piece"), F.col("node.x").alias("x"), F.col("label.x").alias("label")))
    ends = work.join(label.select("piece", F.col("x").alias("u"), F.col("label").alias("lu")), ["piece", "u"], "left").join(label.select("piece", F.col("x").alias("v"), F.col("label").alias("lv")), ["piece", "v"], "left")
    ends = cut(ends.withColumns({"a": F.coalesce("lu", "u"), "b": F.coalesce("lv", "v")}))
    inside, late, single = F.col("a") == F.col("b"), F.col("t") > F.col("middle"), F.col("n") == 1
    # of a piece with one undecided edge, what is inside a component is closed by that edge
    later = ends.where(inside & (late | (single & (F.col("t") > F.col("low"))))).select("t")
    left = ends.where(inside & ~late & ~single).select(F.concat("piece", F.lit("0")).alias("piece"), "u", "v", "t", "low")
    right = ends.where(~inside & ~single).select(F.concat("piece", F.lit("1")).alias("piece"), F.col("a").alias("u"), F.col("b").alias("v"), "t", F.col("middle").alias("low"))
    both = cut(left.unionAll(right))
    return both, cut(later)


def _closed(work: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(t) of the edges that go, piece by piece; a call of Python takes many small pieces, of some `largest` edges at most, and all tasks take part."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["piece", "t"])
        edges = zip(pdf["piece"], pdf["low"], pdf["u"], pdf["v"], pdf["t"])
        gone = [t for (_, low), rows in groupby(edges, key=lambda e: e[:2]) for t in closing([e[2:] for e in rows], int(low))]
        return pd.DataFrame({"t": sorted(gone)}, dtype="int64")

    spark = importable(work.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = max(parts, 4 * work.count() // largest)
    dealt = work.withColumn("deal", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    return dealt.repartition(parts, "deal").groupBy("deal").applyInPandas(run, "t long")


def closing(edges: list[tuple], low: int = -1) -> set[int]:
    """The times t > low of the edges (u, v, t), in the order of t, that earlier ones lead back from."""
    gone: set[int] = set()
    stack = [(edges, low)]
    while stack:
        edges, low = stack.pop()
        new = [t for _, _, t in edges if t > low]
        if not new:
            continue
        middle = new[(len(new) - 1) // 2]
        label = components_of((u, v) for u, v, t in edges if t <= middle)
        left, right = [], []
        for u, v, t in edges:
            a, b = label.get(u, u), label.get(v, v)
            if a != b:
                right.append((a, b, t))
            elif t <= middle and len(new) > 1:
                left.append((u, v, t))
            elif t > low:
                gone.add(t)
        if len(new) > 1:
            stack += [(left, low), (right, middle)]
    return gone


def components_of(edges: Iterable[tuple]) -> dict:
    """node -> one node of its strongly connected component: two searches, the second against the edges in the order in which the first left the nodes."""
    ahead: dict = {}
    back: dict = {}
    for u, v in edges:
        ahead.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    left, seen = [], set()
    for root in ahead:
        stack = [(root, iter(ahead[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, following = stack[-1]
            for v in following:
                if v not in seen:
                    seen.add(v)
                    stack.append((v, iter(ahead.get(v, ()))))
                    break
            else:
                left.append(node)
                stack.pop()
    label: dict = {}
    for root in reversed(left):
        if root not in label:
            label[root], todo = root, [root]
            while todo:
                for u in back.get(todo.pop(), ()):
                    if u not in label:
                        label[u] = root
                        todo.append(u)
    return label
