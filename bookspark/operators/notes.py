"""Notes and documents in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.functions import joined, py_strip
from bookspark.plans.scan import scan

#: Lines of a brief note; how requested depths are written.
BRIEF = 3
DEPTHS = {"very_short": "brief", "short": "brief", "medium": "detailed", "detailed": "detailed", "none": "none", "brief": "brief"}
#: Fixed value: the context of a topic without relations.
UNRELATED = "None identified."
#: Fixed value: why a book is rejected.
NO_NOTES = "No final notes generated."


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), py_strip), lambda s: s != "")


def write_notes(title: Column, content: Column, depth: Column, related: Column | None = None) -> Column:
    """The default note: a bullet a sentence, few or all by depth; no depth mentions the title only.

    related is the context of the title's relations; a detailed note ends with it, if there are any.
    """
    own = sentences(content)
    bullets = lambda a: F.concat(F.lit("- "), F.array_join(a, "\n- "))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv]), depth), F.lit("detailed"))
    text = F.when(kind == "none", F.concat(F.lit("- "), title)).when(kind == "brief", bullets(F.slice(own, 1, BRIEF))).otherwise(bullets(own))
    if related is not None:
        text = F.when((kind == "detailed") & (related != UNRELATED), F.concat(text, F.lit("\n- Related: "), related)).otherwise(text)
    return F.when(F.size(own) > 0, text).otherwise("")


WORD = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def met_by_rarest_word(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """texts(book_id, id, text) and titles(book_id, title, text) -> (book_id, id, start, title) where a text of the book has the title's rarest word, so that the title may start there.

    Both are dealt by book once; words go by hash from there, and are counted and met
    where they are. Neither texts nor titles are compared in pairs, and no word of a text is shuffled.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda rows, c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    rows = texts.select("book_id", "id", none(titles, "title"), "text").unionAll(titles.select("book_id", none(texts, "id"), "title", "text"))
    rows = rows.where("book_id is not null and text is not null").repartition(parts, "book_id")
    rows = rows.select("book_id", "id", "title", F.posexplode(F.transform(_words(F.lower("text")), lambda w: F.xxhash64(w))).alias("at", "w"))
    word = Window.partitionBy("book_id", "w")
    rows = rows.withColumn("n", F.count("id").over(word))
    # each title's rarest word, and all words of texts
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("book_id", "title").orderBy("n", "at"))).where("title is null or k = 1")
    own = F.when(F.col("title").isNotNull(), F.struct("title", F.col("at").alias("offset")))
    rows = rows.select("book_id", "id", "at", own.alias("own"), F.collect_list(own).over(word).alias("ts")).where("own is null and size(ts) > 0")
    return rows.select("book_id", "id", "at", F.inline("ts")).where("at >= offset").select("book_id", "id", (F.col("at") - F.col("offset")).alias("start"), "title")


def leftmost_longest(found: Column) -> Column:
    """Of an array of (start, size, ...) those that stand, from the left, the longest of each start first, without overlap."""
    order = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["size"] - a["size"]))
    step = lambda kept, x: F.when((F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["start"] + F.element_at(kept, -1)["size"]), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(order, F.filter(order, lambda x: F.lit(False)), step)


def refer_to_explained(notes: DataFrame) -> DataFrame:
    """(book_id, node, ord, title, note) -> (book_id, node, note) with references to titles that an earlier node of the book explained.

    A bullet that is such a title by itself becomes `See [title] for details`;
    within a sentence `(see [title] for details)` follows it. Titles are found
    word by word, in any case, from the left, the longest first, without overlap.
    """
    firsts = notes.where(py_strip(F.col("note")) != "").groupBy("book_id", _words(F.lower("title")).alias("words")).agg(F.min("ord").alias("first"), F.min_by("title", "ord").alias("name")).where("size(words) > 0")
    bullets = notes.select("book_id", "node", "ord", F.posexplode_outer(F.split("note", "\n")).alias("pos", "bullet"))
    texts = bullets.select("book_id", F.struct("node", "pos", "ord").alias("id"), F.col("bullet").alias("text"))
    met = met_by_rarest_word(texts, firsts.select("book_id", F.struct("first", "name").alias("title"), F.col("name").alias("text"))).where("title.first < id.ord")
    met = met.select("book_id", "id.node", "id.pos", F.lit(None).cast("string").alias("bullet"), F.struct("start", F.col("title.name").alias("name")).alias("x"))
    # bullets and what may stand in them come together by node, in which the lines are joined
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bullets.select("book_id", "node", "pos", "bullet", F.lit(None).cast(met.schema["x"].dataType).alias("x")).unionAll(met).repartition(parts, "book_id", "node")
    rows = rows.groupBy("book_id", "node", "pos").agg(F.collect_list("bullet").alias("bs"), F.collect_set("x").alias("xs")).select("book_id", "node", "pos", F.explode_outer("bs").alias("bullet"), "xs")
    sized = F.transform("xs", lambda x: F.struct(x["start"].alias("start"), F.size(_words(F.lower(x["name"]))).alias("size"), x["name"].alias("name")))
    # an array of one, so that a bullet is cut once and not for each title
    stands = lambda low: F.filter(sized, lambda x: F.slice(low, x["start"] + 1, x["size"]) == _words(F.lower(x["name"])))
    found = F.get(F.transform(F.array(_words(F.lower("bullet"))), stands), F.lit(0))
    rows = rows.withColumn("found", F.when(F.size("xs") > 0, found)).withColumn("m", F.when(F.size("found") > 0, leftmost_longest(F.col("found"))))
    after = F.map_from_entries(F.transform("m", lambda x: F.struct(x["start"] + x["size"] - 1, F.concat(F.lit(" (see ["), x["name"], F.lit("] for details)")))))
    first = F.get("m", F.lit(0))

    def shown(b: Column) -> Column:
        marked = F.transform(b["own"], lambda w, i: F.concat(F.get(b["gaps"], i), w, F.coalesce(F.element_at(b["after"], i), F.lit(""))))
        whole = F.concat(F.array_join(marked, ""), F.get(b["gaps"], F.size(b["own"])))
        return F.when((first["start"] == 0) & (first["size"] == F.size(b["own"])), F.concat(F.lit("- See ["), first["name"], F.lit("] for details"))).otherwise(whole)

    # an array of one, so that a bullet is cut once and not for each of its words
    cuts = F.array(F.struct(_words(F.col("bullet")).alias("own"), F.split("bullet", WORD).alias("gaps"), after.alias("after")))
    line = F.when(F.col("m").isNull(), F.col("bullet")).otherwise(F.get(F.transform(cuts, shown), F.lit(0)))
    return rows.groupBy("book_id", "node").agg(joined(line, F.col("pos"), "\n").alias("note"))


def explained_context(titles: Column, as_list: bool = False) -> Column:
    text = F.concat(F.lit("- "), F.array_join(titles, "\n- ")) if as_list else F.array_join(titles, ", ")
    return F.when(F.size(titles) > 0, text).otherwise("None yet.")


def already_explained(nodes: DataFrame) -> DataFrame:
    """(book_id, ord, title, content) with n_explained and last_explained: how many earlier nodes had text, and the last one's title.

    The titles themselves are explained_titles(); a node's are its book's first n_explained.
    """
    own = F.when(py_strip(F.coalesce("content", F.lit(""))) != "", F.col("title"))
    return scan(nodes, "book_id", "ord", lasts={"last_explained": own}, sums={"n_explained": own.isNotNull().cast("long")}, own=False)


def explained_titles(nodes: DataFrame) -> DataFrame:
    """(book_id, titles): each book's nodes that have text, in order."""
    own = nodes.where(py_strip(F.coalesce("content", F.lit(""))) != "")
    return own.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("titles"))


def rewrite_nodes(nodes: DataFrame, depth: Column) -> DataFrame:
    """(book_id, ord, title, content) with explained, the context of earlier titles as a list, and rewritten, the default note, trimmed."""
    counted = already_explained(nodes).join(explained_titles(nodes), "book_id", "left")
    earlier = F.slice(F.coalesce("titles", F.expr("cast(array() as array<string>)")), F.lit(1), F.col("n_explained").cast("int"))
    note = py_strip(write_notes(F.col("title"), F.coalesce("content", F.lit("")), depth))
    return counted.select(*nodes.columns, explained_context(earlier, True).alias("explained"), note.alias("rewritten"))


def strip_first_heading(text: Column) -> Column:
    """Text without its first heading line, wherever it is, trimmed."""
    # Fixed value: the pattern of a heading line.
    return py_strip(F.regexp_replace(text, r"(?md)\A((?s:.*?))^(#+\s*.*?\n\n|\s*#+\s*.*?\n)", "$1"))


def assemble_book(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, ord, level, title, content) -> (books with markdown, rejected books with a reason)."""
    part = F.concat(F.expr("repeat('#', level)"), F.lit(" "), "title", F.lit("\n\n"), "content", F.lit("\n\n"))
    kept = F.when(py_strip(F.coalesce("content", F.lit(""))) != "", part)
    out = nodes.groupBy("book_id").agg(joined(kept, F.col("ord"), "").alias("markdown")).withColumn("markdown", py_strip(F.col("markdown")))
    return out.where("markdown <> ''"), out.where("markdown = ''").select("book_id", F.lit(NO_NOTES).alias("reason"))


def assemble_items(answers: DataFrame) -> DataFrame:
    """(request_id, item_pos, item, answer) -> one text a request."""
    part = F.concat(F.lit("# "), "item", F.lit("\n\n"), "answer", F.lit("\n\n"))
    return answers.groupBy("request_id").agg(joined(part, F.col("item_pos"), "").alias("markdown"))


def terminal_format(title: Column, text: Column, width: int = 60) -> Column:
    """Title between rules, then the text, then a rule; the title stands between spaces and a blank line ends it."""
    body = F.replace(F.replace(text, F.lit("### "), F.lit("\n--- ")), F.lit("## "), F.lit("\n\n## "))
    rule = "=" * width
    return F.concat(F.lit(f"\n{rule}\n "), F.upper(title), F.lit(f" \n{rule}\n\n"), body, F.lit(f"\n\n{rule}\n\n"))


def toc(documents: DataFrame, depth: int = 3) -> DataFrame:
    """(book_id, markdown) -> headings up to a level, by line."""
    rows = documents.select("book_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    rows = rows.select("book_id", "line_no", F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 1)).alias("level"), F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 2).alias("title"))
    return rows.where((F.col("level") > 0) & (F.col("level") <= depth))
