"""Titles that sentences have."""

from bookspark.operators import structure


def test_mentions_have_all_words_and_titles_may_have_none(spark):
    s = spark.createDataFrame([("b", 1, "Plan the day."), ("b", 2, "An the --- end"), ("b", 3, "a plan"), ("c", 4, "--- x")], "book_id string, s_id long, sentence string")
    t = spark.createDataFrame([("b", "an the"), ("b", "---")], "book_id string, title string")
    got = {(r["s_id"], r["title"]) for r in structure.map_by_mention(s, t).collect()}
    assert got == {(2, "an the"), (2, "---")}


def test_sentences_are_not_shuffled_for_each_word(spark):
    s = spark.createDataFrame([("b", k, " ".join(f"w{k}x{i}" for i in range(50)) + " plan") for k in range(9)] + [("c", 1, "the plan")], "book_id string, s_id long, sentence string")
    t = s.selectExpr("book_id", "concat('w', s_id, 'x7 ', 'w', s_id, 'x8') as title").unionByName(spark.createDataFrame([("b", "plan"), ("b", "plan")], "book_id string, title string"))
    out = structure.map_by_mention(s, t)
    assert {(r["book_id"], r["s_id"], r["title"]) for r in out.collect()} == {("b", k, x) for k in range(9) for x in ("plan", f"w{k}x7 w{k}x8")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = structure.map_by_mention(s, t)._jdf.queryExecution().executedPlan()
        plan.execute().count()
        found, left = {}, [plan]
        while left:
            p = left.pop()
            for k in range(p.children().size()):
                left.append(p.children().apply(k))
            if p.nodeName() == "Exchange" and "sentence" in p.output().toString():
                found[p.toString()] = p.metrics().apply("shuffleRecordsWritten").value()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found and max(found.values()) <= s.count()
