"""Edges without cycles, in one task and halved by Spark, against a search from each edge."""

import random

import pytest
from pyspark.sql import functions as F

from bookspark.plans import cycles
from bookspark.operators.topics import map_relationships
from bookspark.plans.cycles import acyclic, closing, components_of, strong_components


def closed_by_search(edges):
    """Times of the edges from whose end a way of earlier edges leads back to their start."""
    gone = set()
    for u, v, t in edges:
        seen, todo = {v}, [v]
        while todo:
            x = todo.pop()
            new = {b for a, b, s in edges if a == x and s < t} - seen
            seen |= new
            todo += new
        if u in seen:
            gone.add(t)
    return gone


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", t) for t in range(edges)]


@pytest.mark.parametrize("seed", range(40))
def test_closing_against_search(seed):
    edges = graph(seed, 3 + seed % 12, 4 + seed)
    assert closing(edges) == closed_by_search(edges)


def cycle(nodes, start=0):
    return [(nodes[k], nodes[(k + 1) % len(nodes)], start + k) for k in range(len(nodes))]


CASES = {
    "three": cycle(["a", "b", "c"]),
    "fifty": cycle([f"k{k:02}" for k in range(50)]),
    "nested": cycle(list("abcdef")) + [("c", "a", 6), ("f", "d", 7)],
    "loop and pair": [("a", "a", 0), ("a", "b", 1), ("b", "a", 2), ("b", "c", 3)],
    "no cycle": [("a", "b", 0), ("a", "c", 1), ("b", "c", 2)],
    "nothing": [],
}


@pytest.mark.parametrize("name", CASES)
def test_cycles_are_broken(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([("b1", *r) for r in rows], "book_id string, src string, dst string, t int")
    got = {r["t"] for r in acyclic(df, F.col("t")).collect()}
    assert got == {t for _, _, t in rows} - closed_by_search(rows)
    left = [r for r in rows if r[2] in got]
    assert not closed_by_search(left) and len(set(components_of((u, v) for u, v, _ in left).values())) == len({x for r in left for x in r[:2]})
    if name == "fifty":
        assert len(left) == 49


@pytest.mark.parametrize("largest", [1, 6])
def test_groups_larger_than_a_task_are_halved(spark, largest):
    books = {"x": graph(3, 5, 14), "y": cycle(list("abcdefgh")), "z": [("a", "b", 0)], None: graph(5, 4, 7)}
    rows = [(b, *e) for b, edges in books.items() for e in edges] + [("x", None, "n1", 99), ("y", "a", None, 98)]
    df = spark.createDataFrame(rows, "book_id string, src string, dst string, t int")
    got = {(r["book_id"], r["t"]) for r in acyclic(df, F.col("t"), largest=largest).collect()}
    assert got == {(b, t) for b, edges in books.items() for _, _, t in edges if t not in closed_by_search(edges)} | {("x", 99), ("y", 98)}


def test_strong_components_against_two_searches(spark):
    edges = [e[:2] for e in graph(8, 20, 30)] + [("z", None), ("q", "q")]
    got = {r["node"]: r["label"] for r in strong_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    label = components_of(e for e in edges if None not in e)
    groups = {}
    for node, root in label.items():
        groups.setdefault(root, []).append(node)
    assert got == {n: min(g) for g in groups.values() if len(g) > 1 for n in g}


def test_relations_of_topics_have_no_cycle(spark):
    said = [("s1", "alpha", "alpha depends on beta"), ("s1", "beta", "alpha depends on beta"), ("s2", "beta", "beta depends on gamma"), ("s2", "gamma", "beta depends on gamma"), ("s3", "gamma", "gamma depends on alpha"), ("s3", "alpha", "gamma depends on alpha")]
    rows = spark.createDataFrame([("b", *r) for r in said], "book_id string, s_id string, topic string, sentence string")
    got = {tuple(r)[1:] for r in map_relationships(rows).collect()}
    assert got == {("alpha", "beta", "depends_on"), ("beta", "gamma", "depends_on")}


def test_small_pieces_share_calls_and_all_tasks(spark):
    rows = [(f"b{g}", str(u), str(v), t) for g in range(300) for t, (u, v) in enumerate([(1, 2), (2, 3), (3, 1), (3, 4)])]
    kept = cycles.acyclic(spark.createDataFrame(rows, "book_id string, src string, dst string, t int"), F.col("t"))
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[3] != 2)
    work = spark.createDataFrame([(f"p{g}", u, v, 4 * g + k, -1) for g in range(300) for k, (u, v) in enumerate([("1", "2"), ("2", "1")])], "piece string, u string, v string, t long, low long")
    closed = cycles._closed(work)
    assert sorted(r.t for r in closed.collect()) == [4 * g + 1 for g in range(300)]
    assert closed.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
