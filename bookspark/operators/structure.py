"""Heading trees and the passages that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.functions import joined, norm_title, py_strip, py_words, stable_id
from bookspark.plans.scan import scan
from bookspark.session import cut

#: Fixed value: a heading line has at most so many characters.
LONGEST_HEADING = 120
_TREE = "array<struct<title: string, children: string>>"


def heading_level(line: Column) -> Column:
    """Level of a heading line by # marks, `Chapter N`, or numbering; null for other lines."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?\s+\S", 1)
    level = F.when(marks > 0, marks).when(line.rlike(r"(?i)^chapter\s+\d+"), 1).when(number != "", F.size(F.split(number, r"\.")))
    return F.when(F.length(line) <= LONGEST_HEADING, level)


def heading_title(line: Column) -> Column:
    return py_strip(F.regexp_replace(line, r"^(#{1,6}\s+|\d+(?:\.\d+)*\.?\s+)", ""))


def extract_structure(lines: DataFrame) -> DataFrame:
    """(book_id, line_no, line) -> heading nodes (book_id, line_no, parent_line, level, title).

    The parent is the nearest earlier heading of a smaller level, found in one window pass.
    """
    heads = lines.withColumn("level", heading_level(F.col("line"))).where("level is not null")
    before = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # the place of the last heading of each level so far: levels are as few as a heading line has numbers
    deepest = heads.agg(F.max("level")).first()[0] or 0
    lasts = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("line_no")), True).over(before)) for k in range(1, deepest)]
    parent = F.greatest(*lasts) if len(lasts) > 1 else lasts[0] if lasts else F.lit(None).cast(heads.schema["line_no"].dataType)
    return heads.select("book_id", "line_no", parent.alias("parent_line"), F.col("level").cast("int").alias("level"), heading_title(F.col("line")).alias("title"))


def flatten_structure(trees: DataFrame) -> DataFrame:
    """(book_id, structure JSON) -> nodes in preorder: ord, level, title, path, titles.

    One explode a level, until no node has children, so that it works at any number of books and any depth.
    """
    level = trees.select("book_id", F.expr("cast(array() as array<int>)").alias("ord"), F.expr("cast(array() as array<string>)").alias("titles"), F.col("structure").alias("children"))
    out, k = None, 0
    while out is None or not level.isEmpty():
        k += 1
        level = level.select("book_id", "ord", "titles", F.posexplode(F.from_json("children", _TREE)).alias("p", "n"))
        level = level.select("book_id", F.concat("ord", F.array("p")).alias("ord"), F.concat("titles", F.array("n.title")).alias("titles"), F.col("n.children").alias("children"))
        level = cut(level)
        rows = level.select("book_id", "ord", "titles", F.lit(k).alias("level"))
        out = rows if out is None else out.unionByName(rows)
        level = level.where("children is not null")
    return out.select("book_id", "ord", "level", F.element_at("titles", -1).alias("title"), F.array_join("titles", " > ").alias("path"), "titles")


def path_keys(nodes: DataFrame) -> DataFrame:
    """Nodes that a normalized path leads to, with that path as key, unique in a book.

    Among equal siblings the first is met by a path's last part, and the first
    with children by an inner part.
    """
    rows = nodes.select("book_id", "ord", "titles", F.transform("titles", norm_title).alias("norm"), F.slice("ord", F.lit(1), F.size("ord") - 1).alias("parent"))
    parents = rows.select("book_id", F.col("parent").alias("ord")).distinct().withColumn("inner", F.lit(True))
    rows = rows.join(parents, ["book_id", "ord"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    twins = Window.partitionBy("book_id", "parent", F.element_at("norm", -1))
    rows = rows.withColumn("target_ok", F.row_number().over(twins.orderBy("ord")) == 1).withColumn("first_inner", F.min(F.when(F.col("inner"), F.col("ord"))).over(twins))
    ok = rows.where("inner").select("book_id", F.col("ord").alias("a"), (F.col("ord") == F.col("first_inner")).alias("a_ok"))
    ups = rows.where("target_ok").select("book_id", "ord", "norm", F.explode_outer(F.when(F.size("ord") > 1, F.transform(F.sequence(F.lit(1), F.size("ord") - 1), lambda k: F.slice("ord", F.lit(1), k)))).alias("a"))
    kept = ups.join(ok, ["book_id", "a"], "left").groupBy("book_id", "ord", "norm").agg(F.min(F.coalesce("a_ok", F.lit(True))).alias("ok"))
    return kept.where("ok").select("book_id", "ord", F.array_join("norm", " > ").alias("key"))


def resolve_path(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book_id, title, ...) with the node's ord; mappings that lead nowhere are dropped."""
    key = F.array_join(F.transform(F.split("title", " > "), norm_title), " > ")
    return mappings.withColumn("key", key).join(path_keys(nodes), ["book_id", "key"]).drop("key")


def attach_content(resolved: DataFrame) -> DataFrame:
    """(book_id, ord, unit_no, map_pos, source_text) -> each node's passages in order, by page or by chunk."""
    order = F.struct("unit_no", "map_pos", "source_text")
    return resolved.groupBy("book_id", "ord").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["source_text"]).alias("raw_content"))


def map_by_position(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each line that isn't a heading goes to the last heading before it, however long the book is; joined by unit and heading."""
    marked = lines.join(nodes.select("book_id", "line_no", F.lit(True).alias("head")), ["book_id", "line_no"], "left")
    rows = scan(marked, "book_id", "line_no", lasts={"node_line": F.when(F.col("head"), F.col("line_no"))}).where("head is null and node_line is not null")
    return rows.groupBy("book_id", "unit_no", "node_line").agg(joined(F.col("line"), F.col("line_no"), "\n").alias("source_text"))


def map_by_mention(sentences: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, s_id, sentence) x (book_id, title) -> pairs where the sentence has the title, and each of its words as a word.

    They meet by the title's rarest word in the book; titles without words are looked for in all sentences of their book.
    Sentences and titles are dealt by book once, so that their words are counted and met where they are; what is shuffled
    besides are pairs that share such a word, by numbers of sentences, and the sentences for them.
    """
    words = lambda c: F.array_distinct(py_words(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))))
    number = F.xxhash64("book_id", "s_id")
    parts = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sentences.select("book_id", number.alias("h"), F.lit(None).cast("string").alias("title"), F.col("sentence").alias("text"))
    rows = rows.unionAll(titles.where("title is not null").select("book_id", F.lit(None).cast("long").alias("h"), "title", F.col("title").alias("text")))
    rows = rows.where("book_id is not null and text is not null").repartition(parts, "book_id").withColumn("ws", words(F.col("text")))
    # the empty word is every sentence's, and that of a title without words
    ws = F.when(F.col("title").isNull() | (F.size("ws") == 0), F.concat("ws", F.array(F.lit("")))).otherwise(F.col("ws"))
    rows = rows.select("book_id", "h", "title", F.explode(F.transform(ws, lambda w: F.xxhash64(w))).alias("w"))
    rows = rows.withColumn("n", F.count("h").over(Window.partitionBy("book_id", "w")))
    # each title's rarest word, and all words of sentences
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("book_id", "title").orderBy("n", "w"))).where("title is null or k = 1")
    lists = rows.groupBy("book_id", "w").agg(F.collect_list("h").alias("hs"), F.collect_set("title").alias("ts")).where("size(hs) > 0 and size(ts) > 0")
    met = lists.select("book_id", "hs", F.explode("ts").alias("title")).select(F.struct(F.col("book_id").alias("b"), "title").alias("t"), F.explode("hs").alias("h"))
    # two sentences of one number: each is held against the titles of both
    met = met.groupBy("h").agg(F.collect_set("t").alias("ts"))
    has = F.lower("sentence").contains(F.lower("title"))
    found = sentences.withColumn("h", number).join(met, "h").select("book_id", "s_id", "sentence", F.inline("ts")).where("b = book_id").where(has)
    return found.where(F.size(F.array_except(words(F.col("title")), words(F.col("sentence")))) == 0).select("book_id", "s_id", "title", "sentence")


def topic_rows(content: DataFrame) -> DataFrame:
    """(book_id, ord, titles, page_number, map_pos, source_text) -> one topic row a passage."""
    root = F.size("titles") == 1
    parent = F.when(~root, F.element_at("titles", F.size("titles") - 1))
    out = content.select(
        "book_id", F.element_at("titles", -1).alias("topic"), parent.alias("subtopic"), F.col("page_number").alias("source_page"),
        F.when(root, 0.8).otherwise(0.5).alias("importance_score"), F.col("source_text").alias("raw_content"),
        F.when(root, "core_concept").otherwise("sub_concept").alias("topic_type"), F.array_join("ord", ".").alias("node"), "map_pos",
    )
    return out.withColumn("topic_id", stable_id(F.col("book_id"), F.col("node"), F.col("source_page"), F.col("map_pos"), F.col("raw_content"))).drop("node", "map_pos")


def consolidate(content: DataFrame, answer: str | None = None) -> DataFrame:
    """(book_id, node, raw_content array[, answer]) -> consolidated_content.

    Default: sentences, each once in a node at its first place, joined; a
    model's answer replaces it unless it is blank. A node without passages has an empty text.
    """
    merged = F.array_join("raw_content", "\n\n")
    sentences = F.filter(F.transform(F.split(merged, r"(?<=[.!?])\s+|\n+"), py_strip), lambda s: s != "")
    own = F.array_join(F.array_distinct(sentences), " ")
    if answer:
        own = F.when(F.coalesce(py_strip(F.col(answer)), F.lit("")) != "", F.col(answer)).otherwise(merged)
    return content.withColumn("consolidated_content", F.coalesce(own, F.lit("")))
