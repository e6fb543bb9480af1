"""Typed answers against a plain walk over the JSON, and their defaults."""

import json

import pytest
from pyspark.sql import functions as F

from bookspark.operators import answers as A


def plain_fault(x, path, kind, named):
    """The same rule over Python values; `...` stands for a missing value."""
    if isinstance(kind, A.Again):
        kind = named[kind.name]
    if isinstance(kind, A.Optional):
        return None if x is ... or x is None and kind.nullable else plain_fault(x, path, kind.of, named)
    if x is ...:
        return f"{path} is missing"
    if isinstance(kind, A.Text):
        return f"{path} is not a string" if not isinstance(x, str) else f"{path} is not allowed" if kind.allowed and x not in kind.allowed else None
    if isinstance(kind, A.Flag):
        ok = isinstance(x, bool) or isinstance(x, (int, float)) and x in (0, 1) or isinstance(x, str) and x.lower() in A.TRUE + A.FALSE
        return None if ok else f"{path} is not a boolean"
    if isinstance(kind, A.Many):
        if not isinstance(x, list):
            return f"{path} is not a list"
        return next((f for i, y in enumerate(x) if (f := plain_fault(y, f"{path}[{i}]", kind.of, named))), None)
    if not isinstance(x, dict):
        return f"{path} is not an object"
    return next((f for n, k in kind.fields.items() if (f := plain_fault(x.get(n, ...), f"{path}.{n}", k, named))), None)


def chain(depth, last):
    tree = last
    for k in range(depth):
        tree = {"title": f"t{k}", "children": [{"title": "leaf"}, tree]}
    return {"structure": [{"title": "first", "children": None}, tree]}


INTENT = {"task_type": "a", "scope": "b", "depth": "c", "language_level": "d", "format_type": "e", "normalized_query": "q"}
CASES = {
    "RELATIONS": [{"relationships": []}, {"relationships": [{"topic": "a", "relation": "applies", "more": 1}]}, {"relationships": [{"topic": "a", "relation": "applies"}, {"topic": "a", "relation": "likes"}]}, {"relationships": [{"relation": "applies"}]}, {"relationships": {}}, {}, [], 3, None, {"relationships": [None]}, {"relationships": [[]]}],
    "MERGES": [{"merge_groups": [{"primary": "p"}, {"primary": "q", "secondary": ["a", "é"]}]}, {"merge_groups": [{"primary": "p", "secondary": ["a", 3]}]}, {"merge_groups": [{"primary": "p", "secondary": None}]}, {"merge_groups": [{"primary": 1, "secondary": [2]}]}],
    "INTENT": [INTENT, *[INTENT | {"allow_external_knowledge": x} for x in (True, False, "No", "maybe", 0, 1, 2, 1.0, None, [], "1")], INTENT | {"scope": None}, {k: v for k, v in INTENT.items() if k != "depth"}],
    "STRUCTURE": [chain(0, {"title": "x"}), chain(12, {"title": "x", "children": []}), chain(7, {"title": 3}), chain(3, {"name": "x"}), chain(2, {"title": "x", "children": {}}), {"structure": [chain(2, {"title": 1})["structure"][1], {"title": None}]}, {"structure": ["x"]}, {"structure": 1}],
    "NORMALIZED": [{"canonical_topic_name": "x"}, {"canonical_topic_name": "x", "alternative_names": ["y"]}, {"alternative_names": []}],
    "CLASSIFICATION": [{"topic_type": "example", "explanation_depth": "brief", "definition_status": "reference_only"}, {"topic_type": "example", "explanation_depth": "full", "definition_status": 1}],
}


@pytest.mark.parametrize("name", CASES)
def test_first_fault_against_a_plain_walk(spark, name):
    schema = getattr(A, name)
    rows = [(k, f"```json\n{json.dumps(x)}\n``` and more" if k % 2 else json.dumps(x)) for k, x in enumerate(CASES[name])] + [(98, ""), (99, "{nothing")]
    good, bad = A.parse_typed(spark.createDataFrame(rows, "id int, answer string"), schema)
    want = {k: plain_fault(x, "$", schema.root, schema.named) for k, x in enumerate(CASES[name])} | {98: "empty", 99: "not JSON"}
    assert {r["id"]: r["reason"] for r in bad.select("id", "reason").collect()} == {k: f for k, f in want.items() if f}
    assert {r["id"] for r in good.select("id").collect()} == {k for k, f in want.items() if not f}


def test_typed_values_and_defaults(spark):
    rows = [(0, json.dumps(CASES["MERGES"][0])), (1, "no"), (2, json.dumps({"merge_groups": []}))]
    got = A.typed_or_default(spark.createDataFrame(rows, "id int, answer string"), A.MERGES).orderBy("id").collect()
    assert [[(g["primary"], g["secondary"]) for g in r["merge_groups"]] for r in got] == [[("p", []), ("q", ["a", "é"])], [], []]
    rows = [(k, json.dumps(INTENT | ({} if x is None else {"allow_external_knowledge": x}))) for k, x in enumerate([None, "off", 1])]
    got = A.typed_or_default(spark.createDataFrame(rows, "id int, answer string"), A.INTENT).orderBy("id").collect()
    assert [r["allow_external_knowledge"] for r in got] == [True, False, True]
    rows = [(0, json.dumps(CASES["CLASSIFICATION"][0])), (1, json.dumps(CASES["CLASSIFICATION"][1])), (2, None)]
    given = {"topic_type": F.lit("core_concept"), "explanation_depth": F.lit("detailed"), "definition_status": F.lit("needs_explanation")}
    got = A.typed_or_default(spark.createDataFrame(rows, "id int, answer string"), A.CLASSIFICATION, given).orderBy("id").collect()
    assert [r["topic_type"] for r in got] == ["example", "core_concept", "core_concept"] and got[0]["definition_status"] == "reference_only"
    rows = [(0, json.dumps(chain(2, {"title": "x"}))), (1, "")]
    got = A.typed_or_default(spark.createDataFrame(rows, "id int, answer string"), A.STRUCTURE).select("id", F.to_json("structure").alias("s")).orderBy("id").collect()
    assert json.loads(got[0]["s"]) == chain(2, {"title": "x"})["structure"] and got[1]["s"] == "[]"
    assert A.parse_typed(spark.createDataFrame([], "id int, answer string"), A.STRUCTURE)[0].count() == 0
