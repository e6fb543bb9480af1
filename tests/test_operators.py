"""Edges of the operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from bookspark import sources
from bookspark.functions import norm_title, py_strip
from bookspark.operators import intents, model, notes, retrieval, store, structure, text, topics, vectors
from bookspark.plans.nameindex import NameIndex

PAGES = "book_id string, file_id string, file_ordinal int, page_in_file int, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_page_numbers_run_over_blank_pages_and_files(spark):
    pages = spark.createDataFrame([("b", "x", 1, 1, " "), ("b", "x", 1, 2, " one "), ("b", "y", 2, 1, "two"), ("b", "y", 2, 2, "")], PAGES)
    assert rows(sources.paginate(pages).select("page_number", "text")) == [(2, "one"), (3, "two")]


def test_blank_pages_take_image_texts_in_order(spark):
    pages = spark.createDataFrame([("b", "x", 1, 1, ""), ("b", "x", 1, 2, ""), ("b", "x", 1, 3, "t")], PAGES)
    ocr = spark.createDataFrame([("x", 1, 2, "second"), ("x", 1, 1, "first"), ("x", 1, 3, "")], "file_id string, page_in_file int, img_index int, text string")
    assert rows(sources.resolve_blank_pages(pages, ocr).select("page_in_file", "text")) == [(1, "[SOURCE: IMAGE] first\nsecond"), (3, "t")]


@pytest.mark.parametrize(("name", "title"), [("[12-40] Physics Notes 2020 01 02.pdf", "Physics"), ("Final summary.PDF", "Rewritten Book Notes"), ("Chapter 3  Optics .pdf", "Optics")])
def test_title(spark, name, title):
    assert spark.createDataFrame([(name,)], "n string").select(sources.book_title(F.col("n"))).first()[0] == title


@pytest.mark.parametrize("n", [0, 1, 3, 4, 6])
def test_chunks(spark, n):
    words = [f"w{k}" for k in range(n)]
    df = spark.createDataFrame([(1, " \t".join(words))], "doc_id int, text string")
    assert [r["chunk"] for r in text.chunk_words(df, 3).orderBy("chunk_no").collect()] == [" ".join(words[i : i + 3]) for i in range(0, n, 3)]


@pytest.mark.parametrize(("given", "items"), [("a\n\n b ", ["a", "b"]), ("a, b,,c", ["a", "b", "c"]), ("  ", [""]), ("one", ["one"])])
def test_items(spark, given, items):
    assert spark.createDataFrame([(given,)], "t string").select(text.split_items(F.col("t"))).first()[0] == items


@pytest.mark.parametrize(("title", "norm"), [("1.1 Intro", "1 intro"), ("Ch. X", "x"), (" A. Dog ", "dog"), ("Plain", "plain")])
def test_norm_title(spark, title, norm):
    assert spark.createDataFrame([(title,)], "t string").select(norm_title(F.col("t"))).first()[0] == norm


def test_search_is_ascii_caseless_and_knows_wildcards(spark):
    names = spark.createDataFrame([("Über Alles",), ("Under_score",), ("percent % sign",), (None,)], "name string")
    words = spark.createDataFrame([("ALLES",), ("über",), ("r_s",), ("t%s",), ("zz",), ("er",)], "word string")
    topics = names.select(F.monotonically_increasing_id().alias("ins_seq"), F.col("name").alias("topic"), F.lit(None).cast("string").alias("subtopic"), F.lit("text").alias("raw_content"))
    found = set(rows(NameIndex.build(topics).search(words)))
    assert found == {("ALLES", "Über Alles"), ("r_s", "Under_score"), ("t%s", "percent % sign"), ("er", "Über Alles"), ("er", "Under_score"), ("er", "percent % sign")}


def test_keyword_plan_has_equi_joins_only(spark):
    t = spark.createDataFrame([("alpha beta", None, "c", 1)], "topic string, subtopic string, raw_content string, ins_seq long")
    q = spark.createDataFrame([("q", "alpha gamma", "single_question")], "query_id string, query string, scope string")
    out = retrieval.search_by_keywords(q, t)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows(out) == [("q", 0, 1, "c")]


@pytest.mark.parametrize(("size", "scope", "gap"), [(299, "single_question", True), (300, "single_question", False), (10, "multiple_questions", False)])
def test_gap(spark, size, scope, gap):
    got = spark.createDataFrame([("q", 1, "x" * size)], "query_id string, rank int, raw_content string")
    q = spark.createDataFrame([("q", "?", scope)], "query_id string, query string, scope string")
    assert retrieval.knowledge_gap(got, q).first()["knowledge_gap"] is gap


@pytest.mark.parametrize(("length", "most"), [(100, 10), (101, 20)])
def test_limits(spark, length, most):
    q = spark.createDataFrame([("q", "x" * length)], "query_id string, query string")
    d = spark.range(30).select(F.lit("q").alias("query_id"), F.lit(0).alias("kw_pos"), F.col("id").alias("ins_seq"), F.col("id").cast("string").alias("raw_content"))
    assert retrieval.limit_per_query(d, q).count() == most


def test_paths_take_the_first_twin_and_the_first_inner_twin_with_children(spark):
    tree = '[{"title": "1. A"}, {"title": "A", "children": [{"title": "X"}]}, {"title": "a", "children": [{"title": "Y"}]}]'
    nodes = structure.flatten_structure(spark.createDataFrame([("b", tree)], "book_id string, structure string"))
    asked = spark.createDataFrame([("b", t) for t in ("a", "A > x", "A > Y", "nowhere")], "book_id string, title string")
    assert rows(structure.resolve_path(asked, nodes).select("title", "ord")) == [("A > x", [1, 0]), ("a", [0])]


@pytest.mark.parametrize(("md", "out"), [("# A\n\nbody", "body"), ("x\n## B\ny", "x\ny"), ("no heading", "no heading"), ("# last", "# last")])
def test_first_heading_goes(spark, md, out):
    assert spark.createDataFrame([(md,)], "t string").select(notes.strip_first_heading(F.col("t"))).first()[0] == out


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("k", "a", 1)], "key string, v string, version int")
    new = spark.createDataFrame([("k", None, 2), ("m", "b", 1)], "key string, v string, version int")
    assert rows(store.upsert(old, new, "key")) == [("k", None, 2), ("m", "b", 1)]


def test_answers_are_checked(spark):
    given = ['{"kind": "a"}', '```json\n{"kind": "b"}\n``` x', "```\n{}```", '{"kind": 1}', '{"kind": "z"}', "", "no", "[1]"]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(given)], "id int, answer string")
    good, bad = model.parse_answer(df, {"kind": ["a", "b"]})
    assert rows(good.select("id", "kind")) == [(0, "a"), (1, "b")]
    assert rows(bad.select("id", "reason")) == [(2, "kind is missing"), (3, "kind is not a string"), (4, "kind is not allowed"), (5, "empty"), (6, "not JSON"), (7, "not an object")]


def test_generate_keeps_good_rows_of_a_failed_batch(spark):
    def answers(prompts, config):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    out = model.generate(spark.createDataFrame([("ok",), ("bad",)], "prompt string").coalesce(1), answers)
    assert rows(out.select("prompt", "answer")) == [("bad", ""), ("ok", "OK")]


def test_prompts_fill_slots_once(spark):
    df = spark.createDataFrame([("{b} 100%", None)], "a string, b string")
    assert df.select(model.build_prompt("A {a} B {b}.", a=F.col("a"), b=F.col("b"))).first()[0] == "A {b} 100% B ."


def test_similar_names_lose_no_pair(spark):
    import random

    random.seed(3)
    names = [" ".join(random.sample("abcdefg", random.randint(1, 5))) for _ in range(60)]
    got = {(r["a"], r["b"]) for r in topics.similar_names(spark.createDataFrame([(n,) for n in names], "topic string")).collect()}
    own = sorted(set(names))
    want = {(x, y) for x in own for y in own if x < y and len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) >= topics.SIMILAR - 1e-9}
    assert got == want


def test_long_chains_of_similar_names_are_one_group(spark):
    names = [" ".join(f"w{k + i:03d}" for i in range(4)) for k in range(90)]
    got = topics.dedup_topics(spark.createDataFrame([(n,) for n in [*names, "far off"]], "topic string")).collect()
    assert [(r["primary"], r["secondary"]) for r in got] == [(names[0], names[1:])]


def test_commands_and_routes(spark):
    df = spark.createDataFrame([(" QUIT ",), ("",), ("help",), ("what",)], "t string")
    assert [r[0] for r in df.select(intents.fixed_command(F.col("t"))).collect()] == ["exit", None, "help", None]


def test_zero_vectors_have_no_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_strip_knows_unicode_space(spark):
    assert spark.createDataFrame([("　\x1c a  ",)], "t string").select(py_strip(F.col("t"))).first()[0] == "a"


def test_missing_registry_is_empty(spark, tmp_path):
    assert sources.read_registry(spark, str(tmp_path / "none"), "topic_key string").count() == 0


def test_settings_of_tasks(spark):
    tasks = ["structure", "mapping", "consolidate", "notes", "rewrite_node", "questions", "answer", "classify", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tasks)], "id int, task string")
    got = {r["id"]: (r["temperature"], r["top_p"], r["top_k"], r["max_tokens"], r["task"]) for r in model.with_settings(df).collect()}
    want = [(0.1, None, None, 30000), (0.1, None, None, 30000), (0.2, None, None, 45000), (0.7, None, None, 30000), (0.7, None, None, 30000), (0.1, None, None, None), (0.2, None, None, None), (0.1, 1.0, 1, None), (0.1, 1.0, 1, None)]
    assert got == {k: (*w, t) for k, (w, t) in enumerate(zip(want, tasks))}


@pytest.mark.parametrize(
    ("kind", "want"),
    [
        ("rewrite", ("rewrite_book", "full_book", "medium", "standard", "paragraph", False, "rewrite book")),
        ("export", ("rewrite_book", "full_book", "medium", "standard", "exam_oriented", False, "rewrite book")),
        ("ask", ("question_answer", "single_question", "medium", "standard", "paragraph", False, "why?")),
    ],
)
def test_intents_of_commands(spark, kind, want):
    fields = intents.default_intent(kind, F.col("t"))
    assert tuple(spark.createDataFrame([("why?",)], "t string").select(*[fields[f].alias(f) for f in intents.FIELDS]).first()) == want


@pytest.mark.parametrize(("argument", "scope"), [("book", "full_book"), (None, "full_book"), ("Torts", "specific_topic"), ("Book", "specific_topic")])
def test_bare_rewrites(spark, argument, scope):
    fields = intents.legacy_rewrite_intent(F.col("t"))
    got = spark.createDataFrame([(argument,)], "t string").select(*[fields[f].alias(f) for f in intents.FIELDS]).first()
    assert tuple(got) == ("rewrite_book", scope, "medium", "standard", "paragraph", False, f"rewrite {argument or 'book'}")


def test_files_are_named_or_all_of_a_folder(spark):
    files = spark.createDataFrame([(f"/x/{n}",) for n in ("a.pdf", "b.PDF", "c.txt", "sub/d.pdf", "a.pdf.bak")] + [("/y/a.pdf",)], "path string")
    asked = spark.createDataFrame([("all", "/x", None), ("slash", "/y/", ""), ("one", "/x/", "c.txt"), ("below", "/x", "sub/d.pdf"), ("whole", "/x", "/y/a.pdf"), ("none", "/x", "z.pdf"), ("empty", "/z", None)], "book_id string, folder string, named string")
    chosen, missing = sources.choose_files(asked, files)
    assert rows(chosen) == [("all", "/x/a.pdf"), ("all", "/x/b.PDF"), ("below", "/x/sub/d.pdf"), ("one", "/x/c.txt"), ("slash", "/y/a.pdf"), ("whole", "/y/a.pdf")]
    assert rows(missing.select("book_id", "reason")) == [("empty", sources.NO_FILES), ("none", sources.NO_FILES)]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("what is a tort", ("question_answer", "single_question", "medium", "standard", "paragraph", True, "what is a tort")),
        (" Summarize the book ", ("summarize_book", "full_book", "medium", "standard", "paragraph", True, "Summarize the book")),
        ("very short revision notes for the exam", ("revision_notes", "specific_topic", "very_short", "standard", "exam_oriented", True, "very short revision notes for the exam")),
        ("detailed notes, simple, bullets", ("study_notes", "specific_topic", "detailed", "simple", "bullet", True, "detailed notes, simple, bullets")),
    ],
)
def test_classified_intents_are_in_their_vocabularies(spark, given, want):
    fields = intents.classify_intent(F.col("t"))
    got = tuple(spark.createDataFrame([(given,)], "t string").select(*[fields[f].alias(f) for f in intents.FIELDS]).first())
    assert got == want
    assert all(v in own for v, own in zip(got, (intents.TASKS, intents.SCOPES, intents.LENGTHS, intents.LEVELS, intents.FORMATS)))


def test_topic_types_and_relations(spark):
    texts = ["A tort is defined as a civil wrong of some kind or other", "Take for example a case of trespass to land here", "It applies to all such cases that are met in court", "see torts", "A long enough text about torts and nothing else, again"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    fields = topics.classify(F.lit(1), F.when(F.col("id") == 4, 1).otherwise(2), F.col("t"))
    got = [tuple(r)[1:] for r in df.select("id", *fields.values()).orderBy("id").collect()]
    assert [g[0] for g in got] == ["definition_only", "example", "application", "reference_only", "core_concept"]
    assert [g[2] for g in got] == ["already_explained", "needs_explanation", "needs_explanation", "reference_only", "needs_explanation"]
    said = ["x depends on y", "x unlike y", "x such as y", "x applied to y", "x and y"]
    m = spark.createDataFrame([("b", f"{k}", t, s.replace("x", f"x{k}").replace("y", f"y{k}")) for k, s in enumerate(said) for t in (f"x{k}", f"y{k}")], "book_id string, s_id string, topic string, sentence string")
    edges = {r["src"]: r["relation"] for r in topics.map_relationships(m).collect()}
    assert edges == {"x0": "depends_on", "x1": "exception_to", "x2": "example_of", "x3": "applies", "x4": "explains"}


def test_terminal_text(spark):
    shown = spark.createDataFrame([("t", "## a")], "t string, x string").select(notes.terminal_format(F.col("t"), F.col("x"))).first()[0]
    assert shown == "\n" + "=" * 60 + "\n T \n" + "=" * 60 + "\n\n" + "\n\n## a" + "\n\n" + "=" * 60 + "\n\n"


def test_notes_refer_to_what_was_explained(spark):
    n = spark.createDataFrame([("b", k, k, t, x) for k, (t, x) in enumerate([("Tort", "- A wrong."), ("Harm", "- tort.\n- New"), ("Void", ""), ("Tort", "- Void")])], "book_id string, node int, ord int, title string, note string")
    assert rows(notes.refer_to_explained(n).select("node", "note")) == [(0, "- A wrong."), (1, "- See [Tort] for details\n- New"), (2, ""), (3, "- Void")]


def test_rewritten_nodes_know_earlier_titles(spark):
    n = spark.createDataFrame([("b", k, t, c) for k, (t, c) in enumerate([("A", "One. Two."), ("B", " "), ("C", "Three."), ("D", "Four.")])], "book_id string, ord int, title string, content string")
    got = {r["ord"]: (r["explained"], r["rewritten"]) for r in notes.rewrite_nodes(n, F.lit("detailed")).collect()}
    assert got == {0: ("None yet.", "- One.\n- Two."), 1: ("- A", ""), 2: ("- A", "- Three."), 3: ("- A\n- C", "- Four.")}


def test_heads_stop_at_their_length_and_rejects_have_a_reason(spark):
    p = spark.createDataFrame([("b", k, f"page{k}") for k in range(50)] + [("c", 0, "x")], "book_id string, page_number int, text string")
    heads = text.fallback_head(p, p.where("book_id = 'c'"), 20)
    assert rows(heads) == [("b", "\n\n".join(f"page{k}" for k in range(9))[:20])]
    assert rows(text.rejected(p, p.where("book_id = 'c'")).select("book_id")) == [("b",)]


def test_trees_and_headings_of_any_depth(spark):
    import json

    tree = []
    for k in range(12, 0, -1):
        tree = [{"title": f"t{k}", "children": tree}]
    nodes = structure.flatten_structure(spark.createDataFrame([("b", json.dumps(tree))], "book_id string, structure string"))
    assert sorted(r["level"] for r in nodes.collect()) == list(range(1, 13))
    lines = spark.createDataFrame([("b", k, ".".join("1" * k) + " Title") for k in range(1, 11)], "book_id string, line_no int, line string")
    got = {r["line_no"]: r["parent_line"] for r in structure.extract_structure(lines).collect()}
    assert got == {1: None} | {k: k - 1 for k in range(2, 11)}


def test_a_model_that_varies_loses_no_row(spark):
    import random

    def answers(prompts, config):
        return [random.choice(["", "x"]) for _ in prompts]

    df = spark.range(60).select("id", F.col("id").cast("string").alias("prompt"))
    done, left = model.retry_then_fail(df, answers, F.col("answer") != "")
    assert sorted(r["id"] for r in [*done.collect(), *left.collect()]) == list(range(60))


def test_hits_have_no_limit_and_stay_in_the_book(spark):
    t = spark.createDataFrame([("b", f"alpha {k}", None, f"c{k}", k) for k in range(30)] + [("d", "other", None, "o", 99)], "book_id string, topic string, subtopic string, raw_content string, ins_seq long")
    q = spark.createDataFrame([("q", "the alpha case", "single_question", None), ("w", "all", "full_book", "d")], "query_id string, query string, scope string, book_id string")
    got = retrieval.hits(q, t)
    assert got.where("query_id = 'q'").count() == 30
    assert rows(got.where("query_id = 'w'").select("kw_pos", "ins_seq")) == [(-1, 99)]
    assert retrieval.retrieve(q, t).where("query_id = 'q'").count() == 10
    # without a book, or without the column for it, a whole request takes all topics
    for asked in (q.where("query_id = 'w'").withColumn("book_id", F.lit(None).cast("string")), q.where("query_id = 'w'").drop("book_id")):
        assert retrieval.hits(asked, t).count() == 31
        assert [r["raw_content"] for r in retrieval.retrieve(asked, t).orderBy("rank").collect()] == [f"c{k}" for k in range(10)]


def test_answers_of_a_model_that_fails(spark):
    q = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("c", "x", True), ("d", "x", False)], "query_id string, query string, allow_external_knowledge boolean")
    gap = q.select("query_id", F.lit(True).alias("knowledge_gap"))
    given = spark.createDataFrame([("a", "fine"), ("b", ""), ("d", "fine")], "query_id string, answer string")
    got = spark.createDataFrame([], "query_id string, rank int, raw_content string")
    assert dict(rows(retrieval.answer(q, got, gap, given))) == {"a": "fine", "b": retrieval.FAILED, "c": retrieval.FAILED, "d": retrieval.NO_MATERIAL}


def test_embedding_is_weighed_counts_of_unit_length(spark):
    import math

    from pyspark.ml.feature import HashingTF

    texts = ["a b b", "b c", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: list(r["embedding"]) for r in vectors.embed(df, 64).collect()}
    place = HashingTF(numFeatures=64).indexOf
    words = [(t or "").split(" ") for t in texts]
    for k, own in enumerate(words):
        want = [0.0] * 64
        for w in own:
            want[place(w)] += math.log((4 + 1) / (sum(w in o for o in words) + 1))
        norm = math.sqrt(sum(x * x for x in want))
        assert got[k] == pytest.approx([x / norm if norm else 0.0 for x in want], abs=1e-6)


def test_groups_against_all_pairs(spark):
    import random

    random.seed(6)
    names = sorted({" ".join(random.sample("abcdefghijkl", random.randint(2, 5))) for _ in range(80)})
    label = {n: n for n in names}
    near = [(x, y) for x in names for y in names if x < y and len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) >= topics.SIMILAR - 1e-9]
    for _ in names:
        for x, y in near:
            label[x] = label[y] = min(label[x], label[y])
    want = {frozenset(n for n in names if label[n] == c) for c in set(label.values())}
    got = {frozenset([r["primary"], *r["secondary"]]) for r in topics.dedup_topics(spark.createDataFrame([(n,) for n in names], "topic string")).collect()}
    assert got == {g for g in want if len(g) > 1}


def test_registry_is_cleared(spark, tmp_path):
    path = str(tmp_path / "r")
    entries = spark.createDataFrame([("a",)], "topic_key string")
    sources.write_registry(entries, path)
    sources.clear_registry(entries, path)
    assert sources.read_registry(spark, path, "topic_key string").collect() == []
