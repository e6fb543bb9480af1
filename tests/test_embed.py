"""The norm of an embedding is computed once a vector."""

from bookspark.operators import vectors


def test_norm_once_a_vector(spark):
    out = vectors.embed(spark.createDataFrame([(1, "one two two"), (2, ""), (3, None), (4, "three")], "doc_id long, text string"))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: sum(x * x for x in r["embedding"]) for r in out.collect()}
    assert {k: round(v, 5) for k, v in got.items()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}
