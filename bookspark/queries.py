"""The registered queries of the library and, next to each, the same in DuckDB SQL.

A book is four documents with ids in a row, so that it is bounded; files are
documents, pages lines of text; questions are the user turns of conversations;
heading trees are nations and customers of a region, a thousand customers a
book. All queries read whole tables; query sets are the rows whose id is
divisible by 20.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark import sources
from bookspark.functions import norm_title, py_words, stable_id
from bookspark.operators import answers, bookstore, intents, model, notes, retrieval, store, structure, text, topics, vectors
from bookspark.plans.nameindex import NameIndex
from bookspark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_: str = ""):
    """Register a query under its function's name, with SQL over the adapter's views."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = f"WITH RECURSIVE {', '.join(VIEWS[v] for v in with_.split())} {sql}" if with_ else sql
        return function

    return add


# --- the adapter ---------------------------------------------------------

VIEWS = {
    "raw": "raw AS (SELECT 'b' || CAST(doc_id // 4 AS VARCHAR) AS book_id, doc_id AS file_id, unnest(range(1, len(l) + 1)) AS page_in_file, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))",
    "pages": "pages AS (SELECT * FROM (SELECT book_id, file_id, page_in_file, CASE WHEN page_in_file % 7 = 0 THEN '' ELSE trim(line) END AS text, row_number() OVER (PARTITION BY book_id ORDER BY file_id, page_in_file) AS page_number FROM raw) WHERE text <> '')",
    "topics": "topics AS (SELECT book_id, file_id * 1000000000 + page_in_file AS ins_seq, array_to_string(list_filter(string_split(line, ' '), lambda w: w <> '')[1:4], ' ') AS topic, CASE WHEN page_in_file > 1 THEN book_id END AS subtopic, line AS raw_content, page_in_file AS source_page FROM raw WHERE trim(line) <> '')",
    "asked": "asked AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id, text AS query, 'single_question' AS scope FROM conversations WHERE role = 'user' AND text IS NOT NULL)",
    "kw": "kw AS (SELECT query_id, p AS kw_pos, w AS word FROM (SELECT query_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT query_id, list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '') AS ws FROM asked)) WHERE length(w) >= 4)",
    "names": "names AS (SELECT topic AS name FROM topics UNION SELECT subtopic FROM topics WHERE subtopic IS NOT NULL)",
    "pairs": "words AS (SELECT DISTINCT word FROM kw), pairs AS (SELECT word, name FROM words JOIN names ON contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AND NOT regexp_matches(word, '[%_]') OR regexp_matches(word, '[%_]') AND translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%' || translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '%')",
    "khits": "own AS (SELECT ins_seq, raw_content, topic AS name FROM topics UNION SELECT ins_seq, raw_content, subtopic FROM topics WHERE subtopic IS NOT NULL), wh AS (SELECT DISTINCT word, ins_seq, raw_content FROM pairs JOIN own USING (name)), khits AS (SELECT query_id, kw_pos, ins_seq, raw_content FROM kw JOIN wh USING (word))",
    "seen": "seen AS (SELECT query_id, raw_content, min(kw_pos) AS kw_pos, arg_min(ins_seq, CAST(kw_pos AS HUGEINT) * 1000000000000000000 + ins_seq) AS ins_seq FROM khits GROUP BY query_id, raw_content)",
    "got": "got AS (SELECT query_id, rank, raw_content FROM (SELECT query_id, raw_content, row_number() OVER (PARTITION BY query_id ORDER BY kw_pos, ins_seq) AS rank, query FROM seen JOIN asked USING (query_id)) WHERE rank <= CASE WHEN length(query) > 100 OR contains(query, chr(10)) THEN 20 ELSE 10 END)",
    "gap": "gap AS (SELECT query_id, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks, coalesce(c, 0) AS n_chars, coalesce(n, 0) = 0 OR coalesce(c, 0) < 300 AS knowledge_gap FROM asked LEFT JOIN (SELECT query_id, count(*) AS n, CAST(sum(length(raw_content)) AS BIGINT) AS c FROM got GROUP BY query_id) USING (query_id))",
    "nodes": "cust AS (SELECT r_name || ':' || CAST(c_custkey // 1000 AS VARCHAR) AS book_id, n_name, c_custkey, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), nodes AS (SELECT book_id, [CAST(row_number() OVER (PARTITION BY book_id ORDER BY n_name) - 1 AS INTEGER)] AS ord, 1 AS level, n_name AS title, n_name AS path FROM (SELECT DISTINCT book_id, n_name FROM cust)), leaves AS (SELECT book_id, list_append(ord, CAST(row_number() OVER (PARTITION BY book_id, n_name ORDER BY c_custkey) - 1 AS INTEGER)) AS ord, 2 AS level, c_name AS title, n_name || ' > ' || c_name AS path, c_custkey, c_acctbal FROM nodes JOIN cust USING (book_id) WHERE nodes.title = n_name), tree AS (SELECT book_id, ord, level, title, path FROM nodes UNION ALL SELECT book_id, ord, level, title, path FROM leaves)",
    "freq": "freq AS (SELECT book_id, topic, count(*) AS frequency_count FROM topics GROUP BY book_id, topic)",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").where("text is not null")
    book = F.concat(F.lit("b"), F.floor(F.col("doc_id") / 4).cast("string"))
    return rows.select(book.alias("book_id"), F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("page_in_file", F.col("p") + 1).drop("p")


def raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh line is a blank page."""
    return raw_lines(spark, d).select("book_id", "file_id", F.col("file_id").alias("file_ordinal"), "page_in_file", F.when(F.col("page_in_file") % 7 == 0, "").otherwise(F.col("line")).alias("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return sources.paginate(raw_pages(spark, d))


def topic_table(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_lines(spark, d).where(F.trim("line") != "")
    seq = F.col("file_id") * 1000000000 + F.col("page_in_file")
    return rows.select("book_id", seq.alias("ins_seq"), F.array_join(F.slice(py_words(F.col("line"), 6), 1, 4), " ").alias("topic"), F.when(F.col("page_in_file") > 1, F.col("book_id")).alias("subtopic"), F.col("line").alias("raw_content"), F.col("page_in_file").alias("source_page"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").where("role = 'user' and text is not null")
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"), F.lit("single_question").alias("scope"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with nation, region and book_id: a region's customers, a thousand ids at a time."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.withColumn("book_id", F.concat_ws(":", "r_name", F.floor(F.col("c_custkey") / 1000).cast("string")))


def trees(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, structure): nations and their customers as headings."""
    leaf = F.array_sort(F.collect_list(F.struct("c_custkey", F.struct(F.col("c_name").alias("title")).alias("n"))))
    inner = customers(spark, d).groupBy("book_id", "n_name").agg(F.transform(leaf, lambda x: x["n"]).alias("children"))
    own = F.array_sort(F.collect_list(F.struct("n_name", F.struct(F.col("n_name").alias("title"), "children").alias("n"))))
    return inner.groupBy("book_id").agg(F.to_json(F.transform(own, lambda x: x["n"])).alias("structure"))


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return structure.flatten_structure(trees(spark, d))


_INDEXES: dict[tuple[str, str], NameIndex] = {}


def name_index(spark: SparkSession, d: str) -> NameIndex:
    """The index of a folder's topics, built once a session, as a service would keep it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = NameIndex.build(topic_table(spark, d))
    return _INDEXES[key]


_STORES: dict[tuple[str, str], bookstore.BookStore] = {}


def topic_store(spark: SparkSession, d: str) -> bookstore.BookStore:
    """The store of a folder's topics, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        made = bookstore.BookStore(spark, f"{_folder(spark)}/topics")
        made.upsert(topic_table(spark, d), "ins_seq")
        _STORES[key] = made
    return _STORES[key]


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_by_keywords(asked(spark, d), name_index(spark, d))


def got(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.retrieve_by_keywords(asked(spark, d), name_index(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered with passages, end to end: search, first-seen distinct, limits, coverage, context."""
    q = asked(spark, d)
    found = retrieval.retrieve(q, name_index(spark, d))
    return retrieval.knowledge_gap(found, q).join(retrieval.answer_context(found, q), "query_id")


# --- S: sources and sinks ------------------------------------------------


VIEWS["chosen"] = "chosen AS (SELECT doc_id AS file_id FROM (SELECT doc_id, doc_id // 4 AS b FROM documents) WHERE CASE WHEN b % 4 < 2 THEN doc_id % 4 = 1 WHEN b % 16 = 2 THEN false ELSE doc_id % 3 <> 2 END)"


@query("SELECT book_id, file_id, page_in_file, CAST(page_number AS INTEGER) AS page_number, text FROM (SELECT book_id, file_id, page_in_file, CASE WHEN page_in_file % 7 = 0 THEN '' ELSE trim(line) END AS text, row_number() OVER (PARTITION BY book_id ORDER BY file_id, page_in_file) AS page_number FROM raw JOIN chosen USING (file_id)) WHERE text <> ''", "raw chosen")
def s01a_choose_files(spark, d):
    """Books that name their second file, below their folder or by its whole path; others take the folder's, of which a third are no PDFs; some folders are wrong."""
    ids = _t(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("b"))
    folder = F.concat(F.lit("/books/b"), F.col("b").cast("string"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.get(F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit(".txt")), (F.col("doc_id") % 3).cast("int")))
    files = ids.select(F.concat(folder, F.lit("/"), name).alias("path"), F.col("doc_id").alias("file_id"), "b", folder.alias("folder"), name.alias("name"))
    second = F.max(F.when(F.col("file_id") % 4 == 1, F.when(F.col("b") % 4 == 0, F.col("name")).when(F.col("b") % 4 == 1, F.col("path"))))
    requests = files.groupBy("b").agg(F.min("folder").alias("f"), second.alias("named")).where("b % 4 > 1 or named is not null")
    requests = requests.select(F.concat(F.lit("b"), F.col("b").cast("string")).alias("book_id"), F.when(F.col("b") % 16 == 2, "/none/").otherwise(F.concat("f", F.lit("/"))).alias("folder"), "named")
    chosen, _ = sources.choose_files(requests, files.select("path", "file_id"))
    return sources.paginate(raw_pages(spark, d).join(chosen.select("file_id"), "file_id", "left_semi")).select("book_id", "file_id", "page_in_file", "page_number", "text")


@query("SELECT book_id, file_id, page_in_file, CAST(page_number AS INTEGER) AS page_number, text FROM pages", "raw pages")
def s01_paginate(spark, d):
    return pages(spark, d).select("book_id", "file_id", "page_in_file", "page_number", "text")


@query("SELECT file_id, page_in_file, CASE WHEN page_in_file % 7 = 0 THEN '[SOURCE: IMAGE] ' || left(line, 20) || chr(10) || right(line, 10) ELSE line END AS text FROM raw WHERE line <> '' AND (page_in_file % 7 > 0 OR page_in_file % 14 = 0)", "raw")
def s02_resolve_blank_pages(spark, d):
    rows = raw_lines(spark, d).where("page_in_file % 14 = 0 and line <> ''")
    images = F.array(F.struct(F.lit(1).alias("i"), F.substring("line", 1, 20).alias("t")), F.struct(F.lit(2).alias("i"), F.lit("").alias("t")), F.struct(F.lit(3).alias("i"), F.right("line", F.lit(10)).alias("t")))
    ocr = rows.select("file_id", "page_in_file", F.explode(images).alias("x")).select("file_id", "page_in_file", F.col("x.i").alias("img_index"), F.col("x.t").alias("text"))
    return sources.resolve_blank_pages(raw_pages(spark, d), ocr).select("file_id", "page_in_file", "text")


@query("SELECT p_partkey, trim(regexp_replace('MU ' || p_name || ' ' || p_brand, '\\s+', ' ', 'g')) AS title FROM part")
def s03_book_title(spark, d):
    name = F.concat(F.lit("[1-"), F.col("p_size").cast("string"), F.lit("] Notes MU "), F.col("p_name"), F.lit(" chapter 3 "), F.col("p_brand"), F.lit(".pdf"))
    return _t(spark, d, "part").select("p_partkey", sources.book_title(name).alias("title"))




@query("SELECT book_id, 'file ' || CAST(min(file_id) AS VARCHAR) AS title, 'unknown' AS subject, 'file ' || CAST(min(file_id) AS VARCHAR) AS source_file_name, CAST(count(*) AS INTEGER) AS total_pages FROM pages GROUP BY book_id", "raw pages")
def s04_books_from_pages(spark, d):
    return sources.books_from_pages(pages(spark, d), F.concat(F.lit("file "), F.col("file_id").cast("string")))


@query("SELECT book_id, CASE WHEN late IS NULL THEN even ELSE late END AS title, CASE WHEN late IS NULL THEN 2020 ELSE 2021 END AS processed_year FROM (SELECT o_custkey AS book_id, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS even, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1 AND o_custkey % 3 = 0) AS late FROM orders GROUP BY o_custkey) WHERE even IS NOT NULL OR late IS NOT NULL")
def s05_upsert(spark, d):
    """A store of each customer's even orders, into which the odd ones of every third customer come."""
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("title"))
    books = bookstore.BookStore(spark, f"{_folder(spark)}/books")
    books.upsert(rows.where("title % 2 = 0"), "book_id", "title", F.lit("2020-06-01 00:00:00"))
    books.upsert(rows.where("title % 2 = 1 and book_id % 3 = 0"), "book_id", "title", F.lit("2021-06-01 00:00:00"))
    return books.read().select("book_id", "title", F.year("processed_at").alias("processed_year"))


@query("SELECT DISTINCT lower(topic) AS topic_key, true AS explained FROM topics", "raw topics")
def s06_registry_round_trip(spark, d):
    path = f"{_folder(spark)}/registry"
    sources.write_registry(topic_table(spark, d).select(F.lower("topic").alias("topic_key"), F.lit(True).alias("explained")).distinct(), path)
    return sources.read_registry(spark, path, "topic_key string, explained boolean")


@query("SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS markdown FROM pages GROUP BY book_id", "raw pages")
def s07_write_markdown(spark, d):
    path = f"{_folder(spark)}/markdown"
    sources.write_markdown(text.full_text(pages(spark, d)).withColumnRenamed("full_text", "markdown"), path)
    return sources.read_markdown(spark, path)


@query("SELECT vec_id, len(embedding) AS dim, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 4) AS total FROM embeddings")
def s08_write_embeddings(spark, d):
    path = f"{_folder(spark)}/vectors"
    sources.write_embeddings(_t(spark, d, "embeddings").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def _folder(spark: SparkSession) -> str:
    """A new folder for what a sink writes, in the shared one."""
    import uuid

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# --- Q: stored knowledge -------------------------------------------------


@query("SELECT book_id, count(*) AS pages FROM pages WHERE book_id = 'b3' GROUP BY book_id", "raw pages")
def q01_get_book_by_id(spark, d):
    return store.book_by_id(pages(spark, d).groupBy("book_id").agg(F.count("*").alias("pages")), "b3")


@query("SELECT book_id, count(*) AS pages FROM pages GROUP BY book_id", "raw pages")
def q02_list_all_books(spark, d):
    return pages(spark, d).groupBy("book_id").agg(F.count("*").alias("pages"))


@query("SELECT ins_seq, topic, subtopic, raw_content FROM topics WHERE book_id = 'b3'", "raw topics")
def q03_get_topics_by_book(spark, d):
    return topic_store(spark, d).book("b3").select("ins_seq", "topic", "subtopic", "raw_content")


@query("SELECT book_id, ins_seq, topic, subtopic, raw_content FROM topics", "raw topics")
def q04_get_all_topics(spark, d):
    return topic_table(spark, d).select("book_id", "ins_seq", "topic", "subtopic", "raw_content")


@query("SELECT ins_seq, topic, source_page AS page FROM topics", "raw topics")
def q05_decode_topic_row(spark, d):
    rows = topic_table(spark, d).withColumn("metadata", F.to_json(F.struct(F.col("source_page").alias("page"))))
    return store.decode_topics(rows).select("ins_seq", "topic", F.variant_get("metadata", "$.page", "int").alias("page"))


# --- T: texts ------------------------------------------------------------


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 100 + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)")
def t01_chunk_words(spark, d):
    return text.chunk_words(_t(spark, d, "documents").select("doc_id", "text"), 100)


@query("SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS toc_text FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_number) AS k FROM pages) WHERE k <= 15 GROUP BY book_id", "raw pages")
def t02_toc_window(spark, d):
    return text.toc_window(pages(spark, d))


@query("SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM pages GROUP BY book_id", "raw pages")
def t03_full_text(spark, d):
    return text.full_text(pages(spark, d))


@query("SELECT book_id, left(string_agg(text, chr(10) || chr(10) ORDER BY page_number), 50000) AS head, CASE WHEN book_id LIKE '%2' THEN 'Could not extract the book''s structure.' END AS reason FROM pages WHERE book_id NOT LIKE '%1' GROUP BY book_id", "raw pages")
def t04_fallback_head(spark, d):
    p = pages(spark, d)
    heads = text.fallback_head(p, p.where("book_id like '%1'"))
    return heads.join(text.rejected(heads, heads.where("book_id not like '%2'")), "book_id", "left").select("book_id", "head", "reason")


ITEMS = "items AS (SELECT query_id AS request_id, unnest(l) AS item, unnest(range(0, len(l))) AS item_pos FROM (SELECT query_id, CASE WHEN contains(query, chr(10)) THEN list_filter(list_transform(string_split(query, chr(10)), lambda x: trim(x)), lambda x: x <> '') WHEN contains(query, ',') THEN list_filter(list_transform(string_split(query, ','), lambda x: trim(x)), lambda x: x <> '') ELSE [trim(query)] END AS l FROM asked))"
VIEWS["items"] = ITEMS


@query("SELECT request_id, CAST(item_pos AS INTEGER) AS item_pos, item FROM items", "asked items")
def t05_split_items(spark, d):
    return asked(spark, d).select(F.col("query_id").alias("request_id"), F.posexplode(text.split_items(F.col("query"))).alias("item_pos", "item"))


@query("SELECT query_id, left(string_agg(raw_content, ' ' ORDER BY rank), 200) AS snippet FROM got GROUP BY query_id", "raw topics asked kw names pairs khits seen got")
def t06_context_snippet(spark, d):
    rows = got(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "raw_content"))), lambda x: x["raw_content"]).alias("chunks"))
    return rows.select("query_id", text.context_snippet(F.col("chunks")).alias("snippet"))


@query("SELECT query_id, 'Answer for ' || left(query, 30) AS answer, replace('Answer for ' || left(query, 30), ' ', '_') || '.docx' AS file, 'Exported Content: ' || left(l[1], 20) || '...' AS export, 'Rewritten Topics: ' || array_to_string(l[1:3], ', ') AS rewrite FROM asked JOIN (SELECT request_id AS query_id, list(item ORDER BY item_pos) AS l FROM items GROUP BY request_id) USING (query_id)", "asked items")
def t07_short_title(spark, d):
    title, items = text.answer_title(F.col("query")), text.split_items(F.col("query"))
    return asked(spark, d).select("query_id", title.alias("answer"), text.file_name(title).alias("file"), text.export_title(items).alias("export"), text.rewrite_title(items).alias("rewrite"))


# --- R: retrieval --------------------------------------------------------

R_ALL = "raw topics asked kw names pairs khits seen got"


@query("SELECT q.query_id, t.ins_seq FROM (SELECT CAST(ins_seq AS VARCHAR) AS query_id, translate(left(topic, 6), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM topics WHERE ins_seq % 20 = 0) q JOIN (SELECT *, translate(topic, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS a, translate(subtopic, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM topics) t ON t.a LIKE '%' || q.w || '%' OR coalesce(t.b LIKE '%' || q.w || '%', false)", "raw topics")
def r01_search_topics(spark, d):
    q = topic_table(spark, d).where("ins_seq % 20 = 0").select(F.col("ins_seq").cast("string").alias("query_id"), F.substring("topic", 1, 6).alias("query"))
    return retrieval.search_topics(q, name_index(spark, d), texts=False)


@query("SELECT query_id, kw_pos, ins_seq FROM khits", "raw topics asked kw names pairs khits")
def r02_search_by_keywords(spark, d):
    return keyword_hits(spark, d).select("query_id", F.col("kw_pos").cast("long").alias("kw_pos"), "ins_seq")


@query("SELECT query_id, kw_pos, ins_seq FROM khits WHERE query_id NOT LIKE '%0:%' UNION ALL SELECT query_id, -1, ins_seq FROM asked JOIN topics ON book_id = 'b' || split_part(query_id, ':', 1) WHERE query_id LIKE '%0:%' AND query_id NOT LIKE '%00:%' AND query_id NOT LIKE '0:%' UNION ALL SELECT query_id, -1, ins_seq FROM asked, topics WHERE query_id LIKE '%00:%' OR query_id LIKE '0:%'", "raw topics asked kw names pairs khits")
def r03_route_scope(spark, d):
    """Conversations whose id ends in 0 ask for the whole book of that number, those of 0 and the hundreds for all books."""
    q = asked(spark, d).withColumn("scope", F.when(F.col("query_id").like("%0:%"), "full_book").otherwise(F.col("scope")))
    q = q.withColumn("book_id", F.when(~F.col("query_id").rlike("^(0|.*00):"), F.concat(F.lit("b"), F.split_part("query_id", F.lit(":"), F.lit(1)))))
    return retrieval.hits(q, name_index(spark, d)).select("query_id", F.col("kw_pos").cast("long").alias("kw_pos"), "ins_seq")


@query("SELECT query_id, kw_pos, ins_seq, raw_content FROM khits", "raw topics asked kw names pairs khits")
def r04_hits(spark, d):
    return retrieval.hits(asked(spark, d), name_index(spark, d)).select("query_id", F.col("kw_pos").cast("long").alias("kw_pos"), "ins_seq", "raw_content")


@query("SELECT query_id, raw_content, kw_pos, ins_seq FROM seen", "raw topics asked kw names pairs khits seen")
def r05_first_seen_distinct(spark, d):
    return retrieval.distinct_by_keywords(asked(spark, d), name_index(spark, d)).select("query_id", "raw_content", F.col("kw_pos").cast("long").alias("kw_pos"), "ins_seq")


@query("SELECT query_id, CAST(rank AS INTEGER) AS rank, raw_content FROM got", R_ALL)
def r06_limit_per_query(spark, d):
    return got(spark, d)


@query("SELECT * FROM gap", R_ALL + " gap")
def r07_knowledge_gap(spark, d):
    return retrieval.knowledge_gap(got(spark, d), asked(spark, d))


@query("SELECT query_id, coalesce(c, 'No book content provided.') AS context FROM asked LEFT JOIN (SELECT query_id, string_agg(raw_content, chr(10) || '---' || chr(10) ORDER BY rank) AS c FROM got GROUP BY query_id) USING (query_id)", R_ALL)
def r08_answer_context(spark, d):
    return retrieval.answer_context(got(spark, d), asked(spark, d))


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
VIEWS["papers"] = "papers AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, string_agg(text, chr(10) ORDER BY turn) AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id)"
#: retrieve() of {0}(query_id, query): by the whole query, else by its keywords; as rows of `got_all` with rank.
RETRIEVED = f"own AS (SELECT ins_seq, raw_content, topic AS name FROM topics UNION SELECT ins_seq, raw_content, subtopic FROM topics WHERE subtopic IS NOT NULL), direct AS (SELECT DISTINCT query_id, -1 AS kw_pos, ins_seq, raw_content FROM {{0}} JOIN own ON contains({LOW.format('name')}, {LOW.format('query')}) AND NOT regexp_matches(query, '[%_]')), rkw AS (SELECT query_id, p AS kw_pos, w AS word FROM (SELECT query_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT query_id, list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '') AS ws FROM {{0}} WHERE query_id NOT IN (SELECT query_id FROM direct))) WHERE length(w) >= 4), rnames AS (SELECT DISTINCT name FROM own), rpairs AS (SELECT word, name FROM (SELECT DISTINCT word FROM rkw) JOIN rnames ON contains({LOW.format('name')}, {LOW.format('word')}) AND NOT regexp_matches(word, '[%_]')), every AS (SELECT * FROM direct UNION ALL SELECT DISTINCT query_id, kw_pos, ins_seq, raw_content FROM rkw JOIN rpairs USING (word) JOIN own USING (name)), distinct_ones AS (SELECT query_id, raw_content, min((kw_pos, ins_seq)) AS place FROM every GROUP BY query_id, raw_content), got_all AS (SELECT query_id, rank, raw_content, query FROM (SELECT query_id, raw_content, query, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM distinct_ones JOIN {{0}} USING (query_id)) WHERE rank <= CASE WHEN length(query) > 100 OR contains(query, chr(10)) THEN 20 ELSE 10 END)"
VIEWS["got_papers"] = RETRIEVED.format("papers")


@query("SELECT query_id, CAST(rank AS INTEGER) AS rank, raw_content FROM got_all", "raw topics papers got_papers")
def r09_paper_retrieval(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'user' and text is not null")
    papers = retrieval.paper_queries(rows.select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("pos"), F.col("text").alias("question")))
    return retrieval.retrieve(papers, name_index(spark, d))


LASTS = "lw AS (SELECT query_id, ws[-1] AS l, ws[1] AS f FROM (SELECT query_id, list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '') AS ws FROM asked) WHERE len(ws) > 0), tl AS (SELECT *, translate(topic, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS a, translate(subtopic, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM topics), hit1 AS (SELECT query_id, ins_seq FROM (SELECT query_id, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM lw) JOIN tl ON contains(a, w) OR coalesce(contains(b, w), false)), hit2 AS (SELECT query_id, ins_seq FROM (SELECT query_id, translate(f, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM lw WHERE query_id NOT IN (SELECT query_id FROM hit1)) JOIN tl ON contains(a, w) OR coalesce(contains(b, w), false))"
VIEWS["lasts"] = LASTS


@query("SELECT query_id, CAST(k AS INTEGER) AS rank, ins_seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ins_seq) AS k FROM (SELECT * FROM hit1 UNION ALL SELECT * FROM hit2)) WHERE k <= 3", "raw topics asked lasts")
def r10_last_word_retrieval(spark, d):
    return retrieval.last_word_retrieval(asked(spark, d), name_index(spark, d)).select("query_id", "rank", "ins_seq")


@query("SELECT book_id AS query_id, string_agg('TOPIC: ' || topic || chr(10) || 'CONTENT: ' || raw_content || chr(10) || CASE WHEN subtopic IS NOT NULL THEN 'KEY POINTS:' || chr(10) || '- ' || subtopic || chr(10) || '- ' || topic ELSE '' END, chr(10) || '---' || chr(10) ORDER BY ins_seq) AS context FROM topics GROUP BY book_id", "raw topics")
def r11_labelled_context(spark, d):
    rows = topic_table(spark, d).select(F.col("book_id").alias("query_id"), F.col("ins_seq").alias("rank"), "topic", "raw_content", F.when(F.col("subtopic").isNotNull(), F.array("subtopic", "topic")).otherwise(F.expr("cast(array() as array<string>)")).alias("key_points"))
    return retrieval.labelled_context(rows)


VIEWS["wanted"] = "wanted AS (SELECT request_id || ':' || CAST(item_pos AS VARCHAR) AS query_id, item AS query FROM items)"
VIEWS["got_items"] = RETRIEVED.format("wanted")


@query("SELECT query_id, CAST(rank AS INTEGER) AS rank, raw_content FROM got_all", "raw topics asked items wanted got_items")
def r12_per_item_retrieval(spark, d):
    items = retrieval.item_queries(asked(spark, d).select(F.col("query_id").alias("request_id"), F.col("query").alias("text")))
    return retrieval.retrieve(items, name_index(spark, d))


@query("SELECT query_id, CASE WHEN knowledge_gap AND NOT contains(query, 'the') THEN 'The provided material does not contain sufficient information.' WHEN length(query) % 3 < 2 THEN 'Error: Content generation failed.' ELSE right(query, 9) END AS answer FROM asked JOIN gap USING (query_id)", R_ALL + " gap")
def r13a_answer_of_a_model(spark, d):
    """A model that gives nothing for a third of the questions and no row for another."""
    q, n = asked(spark, d).withColumn("allow_external_knowledge", F.col("query").contains("the")), F.length("query") % 3
    given = q.where(n > 0).select("query_id", F.when(n == 2, F.right("query", F.lit(9))).otherwise("").alias("answer"))
    found = got(spark, d)
    return retrieval.answer(q, found, retrieval.knowledge_gap(found, q), given)


@query("SELECT query_id, CASE WHEN knowledge_gap AND contains(query, ',') THEN 'The provided material does not contain sufficient information.' ELSE '## ' || query || chr(10) || chr(10) || coalesce(p, '') END AS answer FROM asked JOIN gap USING (query_id) LEFT JOIN (SELECT query_id, string_agg(CAST(rank AS VARCHAR) || '. ' || raw_content, chr(10) ORDER BY rank) AS p FROM got GROUP BY query_id) USING (query_id)", R_ALL + " gap")
def r13_answer(spark, d):
    q, found = asked(spark, d).withColumn("allow_external_knowledge", ~F.col("query").contains(",")), got(spark, d)
    return retrieval.answer(q, found, retrieval.knowledge_gap(found, q))


# --- C: structure --------------------------------------------------------


def heading_lines(spark, d):
    """Tree nodes as heading lines, with a body line after each."""
    n = tree_nodes(spark, d).select("book_id", "ord", F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("title")).alias("h"), F.concat(F.lit("Body of "), F.col("title"), F.lit(".")).alias("b"))
    key = lambda last: F.get("ord", F.lit(0)) * 2000000 + (F.coalesce(F.get("ord", F.lit(1)), F.lit(-1)) + 1) * 2 + last
    rows = n.select("book_id", F.explode(F.array(F.struct(key(0).cast("long").alias("line_no"), F.col("h").alias("line")), F.struct(key(1).cast("long").alias("line_no"), F.col("b").alias("line")))).alias("x"))
    return rows.select("book_id", "x.line_no", "x.line")


VIEWS["numbered"] = "numbered AS (SELECT *, CAST(ord[1] AS BIGINT) * 2000000 + (coalesce(ord[2], -1) + 1) * 2 AS line_no FROM tree)"


@query("SELECT book_id, line_no, CASE WHEN level = 2 THEN CAST(ord[1] AS BIGINT) * 2000000 END AS parent_line, level, title FROM numbered", "nodes numbered")
def c00_extract_structure(spark, d):
    return structure.extract_structure(heading_lines(spark, d))


@query("SELECT book_id, array_to_string(ord, '.') AS ord, level, title, path FROM tree", "nodes")
def c01_flatten_structure(spark, d):
    return tree_nodes(spark, d).select("book_id", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"), "level", "title", "path")


@query("SELECT ins_seq, lower(regexp_replace(trim(topic), '^((\\d+\\.)+|[\\p{L}\\p{N}_]+\\.)\\s*', '')) AS norm FROM topics", "raw topics")
def c02_norm_title(spark, d):
    return topic_table(spark, d).select("ins_seq", norm_title(F.col("topic")).alias("norm"))


def tree_mappings(spark, d):
    """Each customer maps its balance to its heading, by a path in other case and numbering; some lead nowhere."""
    c = customers(spark, d)
    path = F.concat(F.lit("1. "), F.lower("n_name"), F.lit(" > "), F.upper("c_name"), F.when(F.col("c_custkey") % 10 == 0, " x").otherwise(""))
    return c.select("book_id", path.alias("title"), (F.col("c_custkey") % 7).cast("int").alias("unit_no"), F.col("c_custkey").alias("map_pos"), F.concat(F.lit("Balance "), F.col("c_custkey").cast("string"), F.lit(".")).alias("source_text"))


def resolved(spark, d):
    return structure.resolve_path(tree_mappings(spark, d), tree_nodes(spark, d))


@query("SELECT book_id, array_to_string(ord, '.') AS ord, c_custkey AS map_pos FROM leaves WHERE c_custkey % 10 <> 0", "nodes")
def c03_resolve_path(spark, d):
    return resolved(spark, d).select("book_id", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"), "map_pos")


@query("SELECT book_id, array_to_string(ord, '.') AS ord, 'Balance ' || CAST(c_custkey AS VARCHAR) || '.' AS raw_content FROM leaves WHERE c_custkey % 10 <> 0", "nodes")
def c04_attach_content(spark, d):
    out = structure.attach_content(resolved(spark, d))
    return out.select("book_id", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"), F.array_join("raw_content", "|").alias("raw_content"))


@query("SELECT book_id, CAST(0 AS INTEGER) AS unit_no, line_no AS node_line, 'Body of ' || title || '.' AS source_text FROM numbered", "nodes numbered")
def c04a_map_by_position(spark, d):
    lines = heading_lines(spark, d).withColumn("unit_no", F.lit(0))
    return structure.map_by_position(lines, structure.extract_structure(lines))


@query("SELECT DISTINCT t.book_id, t.ins_seq AS s_id, q.title FROM topics t JOIN (SELECT DISTINCT book_id, topic AS title FROM topics) q ON t.book_id = q.book_id AND contains(lower(t.raw_content), lower(q.title)) AND len(list_intersect(list_distinct(list_filter(string_split_regex(lower(regexp_replace(t.raw_content, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' +'), lambda w: w <> '')), list_filter(string_split_regex(lower(regexp_replace(q.title, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' +'), lambda w: w <> ''))) = len(list_distinct(list_filter(string_split_regex(lower(regexp_replace(q.title, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' +'), lambda w: w <> '')))", "raw topics")
def c04b_map_by_mention(spark, d):
    t = topic_table(spark, d)
    titles = t.select("book_id", F.col("topic").alias("title")).distinct()
    return structure.map_by_mention(t.select("book_id", F.col("ins_seq").alias("s_id"), F.col("raw_content").alias("sentence")), titles).select("book_id", "s_id", "title")


@query("SELECT book_id, title AS topic, split_part(path, ' > ', 1) AS subtopic, CAST(c_custkey % 7 AS INTEGER) AS source_page, CAST(0.5 AS DOUBLE) AS importance_score, 'Balance ' || CAST(c_custkey AS VARCHAR) || '.' AS raw_content, 'sub_concept' AS topic_type FROM leaves WHERE c_custkey % 10 <> 0", "nodes")
def c05_topic_rows(spark, d):
    content = resolved(spark, d).drop("title").join(tree_nodes(spark, d).select("book_id", "ord", "titles"), ["book_id", "ord"]).withColumnRenamed("unit_no", "page_number")
    return structure.topic_rows(content).select("book_id", "topic", "subtopic", "source_page", "importance_score", "raw_content", "topic_type")


@query("SELECT file_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS consolidated_content FROM (SELECT file_id, list_filter(list_transform(string_split_regex(string_agg(replace(replace(replace(line, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10) ORDER BY page_in_file), chr(10) || '+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM raw GROUP BY file_id)", "raw")
def c06_consolidate(spark, d):
    rows = raw_lines(spark, d).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_in_file", "line"))), lambda x: x["line"]).alias("raw_content"))
    return structure.consolidate(rows).select("file_id", "consolidated_content")


# --- W: notes ------------------------------------------------------------


def noted(spark, d):
    """A node a line of a book, its content the line; every fifth is blank."""
    t = topic_table(spark, d)
    return t.select("book_id", F.col("ins_seq").alias("ord"), (F.col("source_page") % 3 + 1).cast("int").alias("level"), F.col("topic").alias("title"), F.when(F.col("ins_seq") % 5 == 0, "").otherwise(F.col("raw_content")).alias("content"))


VIEWS["noted"] = "noted AS (SELECT book_id, ins_seq AS ord, source_page % 3 + 1 AS level, topic AS title, CASE WHEN ins_seq % 5 = 0 THEN '' ELSE raw_content END AS content FROM topics)"
_S = "list_filter(list_transform(string_split_regex(replace(replace(replace(content, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10) || '+'), lambda x: trim(x)), lambda x: x <> '')"


VIEWS["written"] = f"written AS (SELECT book_id, ord, title, CASE WHEN len(s) = 0 THEN '' WHEN ord % 3 = 0 THEN '- ' || title WHEN ord % 3 = 1 THEN '- ' || array_to_string(s[1:3], chr(10) || '- ') ELSE '- ' || array_to_string(s, chr(10) || '- ') END AS note FROM (SELECT book_id, ord, title, {_S} AS s FROM noted))"


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
VIEWS["referred"] = (
    "related AS (SELECT w.book_id, ord, title, CASE WHEN note <> '' AND ord % 3 = 2 AND r.k IS NOT NULL THEN note || chr(10) || '- Related: ' || w.book_id || ' (explains)' ELSE note END AS note FROM written w LEFT JOIN (SELECT DISTINCT book_id, topic AS k FROM topics WHERE source_page % 2 = 0) r ON r.book_id = w.book_id AND r.k = w.title), "
    f"bul AS (SELECT book_id, ord, p, bullet, {_WORDS.format('bullet')} AS ws FROM (SELECT book_id, ord, unnest(l) AS bullet, unnest(range(0, len(l))) AS p FROM (SELECT book_id, ord, string_split(note, chr(10)) AS l FROM related))), "
    f"tit AS (SELECT book_id, tw, min(ord) AS first, arg_min(title, ord) AS name FROM (SELECT book_id, ord, title, {_WORDS.format('title')} AS tw FROM related WHERE note <> '') WHERE len(tw) > 0 GROUP BY book_id, tw), "
    "met AS (SELECT book_id, ord, p, len(ws) AS n, s, len(tw) AS size, name FROM (SELECT b.*, t.tw, t.name, unnest(range(0, len(ws))) AS s FROM bul b JOIN tit t ON t.book_id = b.book_id AND t.first < b.ord AND list_has_all(b.ws, t.tw)) WHERE ws[s + 1 : s + len(tw)] = tw), "
    "pick(book_id, ord, p, n, s, size, name) AS ((SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY book_id, ord, p ORDER BY s, size DESC) = 1) UNION ALL (SELECT m.* FROM pick k JOIN met m ON m.book_id = k.book_id AND m.ord = k.ord AND m.p = k.p AND m.s >= k.s + k.size QUALIFY row_number() OVER (PARTITION BY m.book_id, m.ord, m.p ORDER BY m.s, m.size DESC) = 1)), "
    "refs AS (SELECT book_id, ord, p, max(n) AS n, list(s + size - 1) AS ends, list(name) AS names, bool_or(s = 0 AND size = n) AS all_ FROM pick GROUP BY book_id, ord, p), "
    "shown AS (SELECT b.ord, b.p, CASE WHEN ends IS NULL THEN bullet WHEN all_ THEN '- See [' || names[1] || '] for details' ELSE array_to_string(list_transform(range(0, len(ows)), lambda i: gaps[i + 1] || ows[i + 1] || coalesce(' (see [' || names[list_position(ends, i)] || '] for details)', '')), '') || gaps[len(ows) + 1] END AS line FROM (SELECT *, regexp_extract_all(bullet, '[\\p{L}\\p{N}]+') AS ows, string_split_regex(bullet, '[\\p{L}\\p{N}]+') AS gaps FROM bul) b LEFT JOIN refs USING (book_id, ord, p))"
)


@query("SELECT ord, string_agg(line, chr(10) ORDER BY p) AS note FROM shown GROUP BY ord", "raw topics noted written referred")
def w01_write_notes(spark, d):
    """Titles at even lines are related to their book."""
    t = topic_table(spark, d)
    edges = t.where("source_page % 2 = 0").select("book_id", F.col("topic").alias("src"), F.col("book_id").alias("dst"), F.lit("explains").alias("relation")).distinct()
    nodes = noted(spark, d).select("book_id", "ord", F.col("title").alias("topic"), "content")
    context = topics.relationship_context(edges, nodes).select("book_id", "topic", "context")
    depth = F.element_at(F.array(F.lit("none"), F.lit("short"), F.lit("detailed")), (F.col("ord") % 3 + 1).cast("int"))
    out = nodes.join(context, ["book_id", "topic"]).select("book_id", F.col("ord").alias("node"), "ord", F.col("topic").alias("title"), notes.write_notes(F.col("topic"), F.col("content"), depth, F.col("context")).alias("note"))
    return notes.refer_to_explained(out).select(F.col("node").alias("ord"), "note")


@query("SELECT ord, count(*) FILTER (WHERE trim(content) <> '') OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n, last_value(CASE WHEN trim(content) <> '' THEN title END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM noted", "raw topics noted")
def w02_already_explained(spark, d):
    return notes.already_explained(noted(spark, d)).select("ord", F.col("n_explained").alias("n"), F.col("last_explained").alias("latest"))


@query("SELECT ord, trim(content) AS text FROM noted WHERE content <> ''", "raw topics noted")
def w03_strip_first_heading(spark, d):
    rows = noted(spark, d).where("content <> ''")
    return rows.select("ord", notes.strip_first_heading(F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("content"))).alias("text"))


@query("SELECT book_id, trim(string_agg(repeat('#', CAST(level AS INTEGER)) || ' ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY ord)) AS markdown FROM noted WHERE trim(content) <> '' GROUP BY book_id", "raw topics noted")
def w04_assemble_book(spark, d):
    return notes.assemble_book(noted(spark, d))[0]


@query("SELECT request_id, string_agg('# ' || item || chr(10) || chr(10) || item || '!' || chr(10) || chr(10), '' ORDER BY item_pos) AS markdown FROM items GROUP BY request_id", "asked items")
def w05_assemble_items(spark, d):
    rows = t05_split_items(spark, d).withColumn("answer", F.concat("item", F.lit("!")))
    return notes.assemble_items(rows)


@query("SELECT query_id, chr(10) || repeat('=', 60) || chr(10) || ' ' || upper(query_id) || ' ' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || replace(replace('## ' || query || chr(10) || '### x', '### ', chr(10) || '--- '), '## ', chr(10) || chr(10) || '## ') || chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) AS shown FROM asked", "asked")
def w06_terminal_format(spark, d):
    return asked(spark, d).select("query_id", notes.terminal_format(F.col("query_id"), F.concat(F.lit("## "), "query", F.lit("\n### x"))).alias("shown"))


@query("SELECT book_id, CAST(level AS INTEGER) AS level, title, count(*) AS n FROM noted WHERE trim(content) <> '' AND level <= 2 GROUP BY book_id, level, title", "raw topics noted")
def w07_toc(spark, d):
    out = notes.toc(notes.assemble_book(noted(spark, d))[0], 2)
    return out.groupBy("book_id", "level", "title").agg(F.count("*").alias("n"))


@query("SELECT ord, CASE WHEN n > 0 THEN '- ' || s ELSE 'None yet.' END AS explained, note AS rewritten FROM written JOIN (SELECT a.ord, count(b.ord) AS n, string_agg(b.title, chr(10) || '- ' ORDER BY b.ord) AS s FROM noted a LEFT JOIN noted b ON a.book_id = b.book_id AND b.ord < a.ord AND trim(b.content) <> '' GROUP BY a.ord) USING (ord)", "raw topics noted written")
def w08_rewrite_node(spark, d):
    depth = F.element_at(F.array(F.lit("none"), F.lit("short"), F.lit("detailed")), (F.col("ord") % 3 + 1).cast("int"))
    return notes.rewrite_nodes(noted(spark, d), depth).select("ord", "explained", "rewritten")


# --- I: intents ----------------------------------------------------------

_INPUT = "CASE WHEN substr(query_id, -1) = '0' THEN ' Quit ' WHEN substr(query_id, -1) = '2' THEN 'help' ELSE query END"


def inputs(spark, d):
    last = F.right("query_id", F.lit(1))
    return asked(spark, d).select("query_id", F.when(last == "0", " Quit ").when(last == "2", "help").otherwise(F.col("query")).alias("text"))


@query("SELECT query_id, CASE WHEN substr(query_id, -1) = '0' THEN 'exit' WHEN substr(query_id, -1) = '2' THEN 'help' END AS command FROM asked", "asked")
def i01_fixed_command(spark, d):
    return inputs(spark, d).select("query_id", intents.fixed_command(F.col("text")).alias("command"))


@query("SELECT url, regexp_replace(url, '.', '') IS NOT NULL AND page_id % 2 = 0 AS is_ingest FROM pages")
def i02_is_ingest_request(spark, d):
    rows = _t(spark, d, "pages").select("url", F.concat(F.lit('"C:\\x'), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(".txt"), F.lit('"')).alias("text"))
    return intents.ingest_requests(rows, rows.select(F.lit("y.pdf").alias("path"))).select("url", "is_ingest")


#: Phrases before the questions, and the (task, scope, depth, level, format) that they mean.
_PHRASES = (
    ("", "question_answer", "single_question", "medium", "standard", "paragraph"),
    ("Summary of the book: ", "summarize_book", "full_book", "medium", "standard", "paragraph"),
    ("Detailed study notes in bullets on ", "study_notes", "specific_topic", "detailed", "standard", "bullet"),
    ("Short revision notes for the exam, ", "revision_notes", "specific_topic", "short", "standard", "exam_oriented"),
    ("REWRITE everything in a simple way ", "rewrite_book", "full_book", "medium", "simple", "paragraph"),
    ("A very short, advanced list ", "question_answer", "single_question", "very_short", "advanced", "bullet"),
)


def _phrased(k):
    """The k-th of the phrases' values, by the length of the question, in SQL."""
    cases = " ".join(f"WHEN {n} THEN '{row[k]}'" for n, row in enumerate(_PHRASES))
    return f"CASE length(query) % {len(_PHRASES)} {cases} END"


@query(f"SELECT query_id, {_phrased(1)} AS task_type, {_phrased(2)} AS scope, {_phrased(3)} AS depth, {_phrased(4)} AS language_level, {_phrased(5)} AS format_type, true AS allow_external_knowledge, {_phrased(0)} || query AS normalized_query FROM asked", "asked")
def i03_classify_intent(spark, d):
    phrase = F.get(F.array(*[F.lit(row[0]) for row in _PHRASES]), F.length("query") % len(_PHRASES))
    c = intents.classify_intent(F.concat(phrase, "query"))
    return asked(spark, d).select("query_id", *[c[f].alias(f) for f in intents.FIELDS])


@query("SELECT query_id, 'question_answer' AS task_type, 'single_question' AS scope, 'medium' AS depth, 'standard' AS language_level, 'paragraph' AS format_type, true AS allow_external_knowledge, query AS normalized_query FROM asked", "asked")
def i04_fallback_intent(spark, d):
    rows = asked(spark, d).select("query_id", F.col("query").alias("text"), *[F.lit(None).cast("boolean" if f.startswith("allow") else "string").alias(f) for f in intents.FIELDS])
    return intents.with_fallback(rows).select("query_id", *intents.FIELDS)


_K = "length(query) % 5"


@query(f"SELECT query_id, CASE WHEN {_K} = 2 THEN 'question_answer' ELSE 'rewrite_book' END AS task_type, CASE WHEN {_K} = 2 THEN 'single_question' WHEN {_K} = 3 THEN 'specific_topic' ELSE 'full_book' END AS scope, 'medium' AS depth, 'standard' AS language_level, CASE WHEN {_K} = 1 THEN 'exam_oriented' ELSE 'paragraph' END AS format_type, false AS allow_external_knowledge, CASE WHEN {_K} = 2 THEN query WHEN {_K} = 3 THEN 'rewrite ' || query ELSE 'rewrite book' END AS normalized_query FROM asked", "asked")
def i05_default_intents(spark, d):
    """Rewrite, export and ask, and the bare rewrite of a topic and of no argument."""
    kinds = [*[intents.default_intent(k, F.col("query")) for k in ("rewrite", "export", "ask")], intents.legacy_rewrite_intent(F.col("query")), intents.legacy_rewrite_intent(F.lit(None).cast("string"))]
    pick = lambda f: F.get(F.array(*[k[f] for k in kinds]), F.length("query") % 5)
    return asked(spark, d).select("query_id", *[pick(f).alias(f) for f in intents.FIELDS])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'retrieve' WHEN source LIKE '%1' THEN 'rewrite' ELSE 'refused' END AS route FROM documents")
def i06_route_intent(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("source").alias("book_id"), F.when(F.col("doc_id") % 2 == 0, "single_question").otherwise("full_book").alias("scope"))
    return intents.route_intent(rows, rows.where("book_id like '%1'")).select("doc_id", "route")


# --- M: model calls ------------------------------------------------------


@query("SELECT query_id, 'Q: ' || query || chr(10) || 'External: true' || chr(10) || 'Sizes: [' || CAST(length(query) AS VARCHAR) || ',null]{q}' AS prompt FROM asked", "asked")
def m01_build_prompts(spark, d):
    sizes = F.to_json(F.array(F.length("query"), F.lit(None).cast("int")))
    prompt = model.build_prompt("Q: {q}\nExternal: {x}\nSizes: {sizes}", q=F.col("query"), x=F.lit(True), sizes=F.concat(sizes, F.lit("{q}")))
    return asked(spark, d).select("query_id", prompt.alias("prompt"))


_TASKS = ("structure", "mapping", "consolidate", "notes", "rewrite_node", "questions", "answer", "other")


@query("SELECT query_id, CAST(CASE length(query) % 8 WHEN 2 THEN 0.2 WHEN 3 THEN 0.7 WHEN 4 THEN 0.7 WHEN 6 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS temperature, CASE WHEN length(query) % 8 = 7 THEN CAST(1.0 AS DOUBLE) END AS top_p, CASE WHEN length(query) % 8 = 7 THEN 1 END AS top_k, CASE WHEN length(query) % 8 IN (0, 1, 3, 4) THEN 30000 WHEN length(query) % 8 = 2 THEN 45000 END AS max_tokens FROM asked", "asked")
def m02_generation_config(spark, d):
    task = F.get(F.array(*map(F.lit, _TASKS)), F.length("query") % len(_TASKS))
    return model.with_settings(asked(spark, d).withColumn("task", task)).select("query_id", "temperature", "top_p", "top_k", "max_tokens")


@query("SELECT query_id, list_last(string_split(query, chr(10))) AS answer FROM asked", "asked")
def m03_generate(spark, d):
    return model.generate(asked(spark, d).select("query_id", F.col("query").alias("prompt"))).select("query_id", "answer")


#: Relations by the length of a word; the last is none.
_RELATED = ("depends_on", "explains", "applies", "exception_to", "example_of", "likes")
VIEWS["said"] = "said AS (SELECT query_id, query, length(query) AS n, list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '') AS ws FROM asked)"
_BAD_EDGE = "list_position(list_transform(ws, lambda w: length(w) % 6 = 5), true)"


def fenced(json, number):
    """Every other answer in a code fence."""
    return F.when(number % 2 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n``` and more"))).otherwise(json)


def edge_answers(spark, d):
    """A model's relations: each word of a question, related by its length."""
    n = F.length("query")
    edges = F.transform(py_words(F.col("query")), lambda w: F.struct(w.alias("topic"), F.get(F.array(*map(F.lit, _RELATED)), F.length(w) % 6).alias("relation")))
    body = F.when(n % 7 == 0, F.to_json(F.struct(edges.alias("relation")))).when(n % 7 == 1, '{"relationships": "none"}').otherwise(F.to_json(F.struct(edges.alias("relationships"))))
    return asked(spark, d).select("query_id", fenced(body, n).alias("answer"))


def _checked(answers_, schema, *shown):
    good, bad = answers.parse_typed(answers_, schema)
    return good.select("query_id", *shown, F.lit(None).cast("string").alias("reason")).unionByName(bad.select("query_id", "reason"), True)


@query(f"SELECT query_id, CASE WHEN n % 7 = 0 THEN '$.relationships is missing' WHEN n % 7 = 1 THEN '$.relationships is not a list' WHEN {_BAD_EDGE} > 0 THEN '$.relationships[' || CAST({_BAD_EDGE} - 1 AS VARCHAR) || '].relation is not allowed' END AS reason, CASE WHEN n % 7 > 1 AND coalesce({_BAD_EDGE}, 0) = 0 THEN array_to_string(list_transform(ws, lambda w: w || ':' || (['depends_on', 'explains', 'applies', 'exception_to', 'example_of'])[length(w) % 6 + 1]), ' ') END AS edges FROM said", "asked said")
def m04_parse_answer(spark, d):
    edges = F.array_join(F.transform("relationships", lambda e: F.concat(e["topic"], F.lit(":"), e["relation"])), " ").alias("edges")
    return _checked(edge_answers(spark, d), answers.RELATIONS, edges)


@query("SELECT query_id, CASE WHEN n % 3 = 0 THEN '$.merge_groups[1].secondary[' || CAST(len(ws) AS VARCHAR) || '] is not a string' END AS reason, CASE WHEN n % 3 > 0 THEN query || '=|' || ws[1] || '=' || array_to_string(ws, ',') END AS merged FROM said", "asked said")
def m04a_parse_merge_groups(spark, d):
    """Groups of which the first leaves its names out; every third has a number as the last name of its second."""
    n, ws = F.length("query"), py_words(F.col("query"))
    names = F.concat_ws(",", F.transform(ws, lambda w: F.to_json(F.array(w))))
    listed = F.concat(F.lit("["), F.regexp_replace(names, r'"\],\["', '","'), F.when(n % 3 == 0, ",[7]").otherwise(""), F.lit("]"))
    listed = F.regexp_replace(F.regexp_replace(listed, r'^\[\["', '["'), r'"\](,\[7\])?\]$', '"$1]')
    listed = F.replace(listed, F.lit(",[7]]"), F.lit(",7]"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    body = F.concat(F.lit('{"merge_groups": [{"primary": '), quoted(F.col("query")), F.lit('}, {"primary": '), quoted(F.get(ws, F.lit(0))), F.lit(', "secondary": '), listed, F.lit("}]}"))
    merged = F.array_join(F.transform("merge_groups", lambda g: F.concat(g["primary"], F.lit("="), F.array_join(g["secondary"], ","))), "|").alias("merged")
    return _checked(asked(spark, d).select("query_id", fenced(body, n).alias("answer")), answers.MERGES, merged)


#: How a model says whether other knowledge is allowed, by the length of the question: left out, a text, a number, false, and no boolean.
_SAID_ALLOWED = ("", ',"allow_external_knowledge":"No"', ',"allow_external_knowledge":1', ',"allow_external_knowledge":false', ',"allow_external_knowledge":"perhaps"')


@query("SELECT query_id, CASE WHEN n % 5 = 4 THEN '$.allow_external_knowledge is not a boolean' END AS reason, CASE WHEN n % 5 < 4 THEN query END AS normalized_query, CASE WHEN n % 5 < 4 THEN n % 5 IN (0, 2) END AS allow_external_knowledge, CASE WHEN n % 5 < 4 THEN 'question_answer' END AS task_type FROM said", "asked said")
def m04b_parse_intent(spark, d):
    n = F.length("query")
    fields = [F.col("query").alias("normalized_query"), *[F.lit(v).alias(f) for f, v in zip(intents.FIELDS, intents.FALLBACK) if f not in ("normalized_query", "allow_external_knowledge")]]
    body = F.concat(F.regexp_replace(F.to_json(F.struct(*fields)), r"\}$", ""), F.get(F.array(*map(F.lit, _SAID_ALLOWED)), n % 5), F.lit("}"))
    return _checked(asked(spark, d).select("query_id", fenced(body, n).alias("answer")), answers.INTENT, "normalized_query", "allow_external_knowledge", "task_type")


_DEPTH = "length(book_id) % 3 * 2 + CAST(right(book_id, 1) AS INTEGER) % 3"


@query(f"SELECT book_id AS query_id, CASE WHEN CAST(right(book_id, 1) AS INTEGER) % 2 = 1 THEN '$.structure[0]' || repeat('.children[0]', {_DEPTH} + 1) || '.title is missing' END AS reason, CASE WHEN CAST(right(book_id, 1) AS INTEGER) % 2 = 0 THEN count(*) + {_DEPTH} END AS n_nodes FROM tree GROUP BY book_id", "nodes")
def m04c_parse_heading_tree(spark, d):
    """The trees of customers some levels down; of every other the first customer has no title."""
    depth, last = F.length("book_id") % 3 * 2 + F.right("book_id", F.lit(1)).cast("int") % 3, F.right("book_id", F.lit(1)).cast("int")
    broken = F.when(last % 2 == 1, F.regexp_replace("structure", r'\A(.*?)"title":"Customer', '$1"name":"Customer')).otherwise(F.col("structure"))
    body = F.concat(F.lit('{"structure": '), F.repeat(F.lit('[{"title": "part", "children": '), depth), broken, F.repeat(F.lit("}]"), depth), F.lit("}"))
    rows = trees(spark, d).select(F.col("book_id").alias("query_id"), fenced(body, last).alias("answer"))
    good, bad = answers.parse_typed(rows, answers.STRUCTURE)
    nodes = structure.flatten_structure(good.select(F.col("query_id").alias("book_id"), F.to_json("structure").alias("structure")))
    counts = nodes.groupBy(F.col("book_id").alias("query_id")).agg(F.count("*").alias("n_nodes"))
    return counts.select("query_id", F.lit(None).cast("string").alias("reason"), "n_nodes").unionByName(bad.select("query_id", "reason"), True)


@query("SELECT query_id, CASE WHEN length(query) % 2 = 0 THEN 'a|' || query ELSE left(query, 100) END AS items FROM asked", "asked")
def m05_parse_string_list(spark, d):
    rows = asked(spark, d).withColumn("answer", F.when(F.length("query") % 2 == 0, F.concat(F.lit("```json"), F.to_json(F.array(F.lit("a"), F.col("query"))), F.lit("```"))).otherwise("no list"))
    return rows.select("query_id", F.array_join(model.parse_string_list(F.col("answer"), F.col("query")), "|").alias("items"))


@query("SELECT query_id, CASE WHEN contains(query, chr(10)) THEN 'second' ELSE 'first' END AS answer FROM asked WHERE length(query) % 5 <> 0", "asked")
def m06_retry_then_fail(spark, d):
    def answers(prompts, config):
        return ["" if len(p) % 5 == 0 or "\n" in p and config["attempt"] == 1 else ("first", "second")[config["attempt"] - 1] for p in prompts]

    done, _ = model.retry_then_fail(asked(spark, d).select("query_id", F.col("query").alias("prompt")), answers, F.col("answer") != "")
    return done.select("query_id", "answer")


_KINDS = ("core_concept", "sub_concept", "reference_only", "example", "application", "definition_only", "wrong", "")


@query(f"SELECT query_id, CASE n % 8 WHEN 1 THEN 'sub_concept' WHEN 2 THEN 'reference_only' WHEN 3 THEN 'example' WHEN 4 THEN 'application' WHEN 5 THEN 'definition_only' ELSE 'core_concept' END AS topic_type, CASE WHEN n % 8 >= 6 THEN 'detailed' WHEN n % 3 = 0 THEN 'none' ELSE 'brief' END AS explanation_depth, CASE WHEN n % 8 >= 6 THEN 'needs_explanation' ELSE 'already_explained' END AS definition_status, CAST(CASE WHEN n % 7 > 1 AND coalesce({_BAD_EDGE}, 0) = 0 THEN len(ws) ELSE 0 END AS INTEGER) AS n_edges FROM said", "asked said")
def m07_default_on_failure(spark, d):
    """Classifications of which a quarter fails, and relations, whose default is an empty list."""
    n = F.length("query")
    fields = F.get(F.array(*map(F.lit, _KINDS)), n % 8).alias("topic_type"), F.when(n % 3 == 0, "none").otherwise("brief").alias("explanation_depth"), F.lit("already_explained").alias("definition_status")
    rows = asked(spark, d).select("query_id", F.when(n % 8 == 7, "").otherwise(F.to_json(F.struct(*fields))).alias("answer"))
    kinds = answers.typed_or_default(rows, answers.CLASSIFICATION, {f: F.lit(v) for f, v in zip(answers.CLASSIFICATION.root.fields, topics.FAILED)})
    edges = answers.typed_or_default(edge_answers(spark, d), answers.RELATIONS)
    return kinds.select("query_id", *answers.CLASSIFICATION.root.fields).join(edges.select("query_id", F.size("relationships").alias("n_edges")), "query_id")


# --- G: topic intelligence -----------------------------------------------

_FOLD = "array_to_string(list_filter(string_split_regex(regexp_replace(lower(regexp_replace(trim(topic), '^((\\d+\\.)+|[\\p{L}\\p{N}_]+\\.)\\s*', '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +'), lambda w: w <> ''), ' ')"


@query(f"SELECT arg_min(topic, r) AS canonical_topic_name, CAST(count(*) - 1 AS BIGINT) AS n_alternatives FROM (SELECT *, row_number() OVER (ORDER BY n DESC, length(topic) DESC, topic) AS r, {_FOLD} AS k FROM (SELECT topic, count(*) AS n FROM topics GROUP BY topic)) GROUP BY k", "raw topics")
def g01_normalize_topics(spark, d):
    return topics.normalize_topics(topic_table(spark, d)).select("canonical_topic_name", F.size("alternative_names").cast("long").alias("n_alternatives"))


@query()
def g01a_normalize_with_short_forms(spark, d):
    """Every fourth line gives its topic's first letters in brackets, which are topics elsewhere."""
    t = topic_table(spark, d)
    short = F.upper(F.array_join(F.transform(py_words(F.col("topic")), lambda w: F.left(w, F.lit(1))), ""))
    texts = t.where("ins_seq % 4 = 0").select(F.concat("topic", F.lit(" ("), short, F.lit(") "), "raw_content").alias("text"))
    names = t.select("topic").unionByName(t.where("ins_seq % 4 = 1").select(short.alias("topic")))
    out = topics.normalize_topics(names, texts)
    return out.select("canonical_topic_name", F.array_join("alternative_names", "|").alias("alternatives"))


VIEWS["similar"] = "tokens AS (SELECT topic, len(l) AS n, unnest(l) AS t FROM (SELECT topic, list_distinct(list_filter(string_split_regex(lower(topic), '\\s+'), lambda w: w <> '')) AS l FROM (SELECT DISTINCT topic FROM topics))), near AS (SELECT a.topic AS a, b.topic AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.topic <> b.topic GROUP BY a.topic, b.topic, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 0.000000001), reach(node, c) AS (SELECT DISTINCT a, a FROM near UNION SELECT near.b, reach.c FROM reach JOIN near ON near.a = reach.node), grouped AS (SELECT c, list(node ORDER BY length(node) DESC, node) AS g FROM (SELECT node, min(c) AS c FROM reach GROUP BY node) GROUP BY c)"


@query("SELECT g[1] AS primary, array_to_string(list_sort(g[2:]), '|') AS secondary FROM grouped", "raw topics similar")
def g02_dedup_topics(spark, d):
    return topics.dedup_topics(topic_table(spark, d)).select("primary", F.array_join("secondary", "|").alias("secondary"))


@query()
def g02a_dedup_with_context(spark, d):
    """Names with the first 200 characters of their first passage."""
    snippet = text.context_snippet(F.array("raw_content"))
    rows = topic_table(spark, d).groupBy("topic").agg(F.min_by(snippet, "ins_seq").alias("snippet"))
    return topics.dedup_topics(rows).select("primary", F.array_join("secondary", "|").alias("secondary"))


@query("SELECT ins_seq, CASE WHEN contains(topic, ' ') THEN split_part(topic, ' ', 1) ELSE topic END AS topic FROM topics", "raw topics")
def g03_apply_merges(spark, d):
    t = topic_table(spark, d)
    pairs = t.where("topic like '% %'").select(F.split_part("topic", F.lit(" "), F.lit(1)).alias("primary"), "topic").distinct()
    return topics.apply_merges(t, pairs.groupBy("primary").agg(F.collect_list("topic").alias("secondary"))).select("ins_seq", "topic")


@query("SELECT * FROM freq", "raw topics freq")
def g04_topic_frequency(spark, d):
    return topics.topic_frequency(topic_table(spark, d))


#: What is added to a sentence, by its number: each cue of a type or relation, and none.
_ADDED = ("", " This means that.", " For example.", " It is used in it.", " It depends on it.", " Unlike that.")
_SAID = "CASE {} % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_ADDED)) + " END"


def said(text, number):
    return F.concat(text, F.get(F.array(*map(F.lit, _ADDED)), (number % len(_ADDED)).cast("int")))


@query(f"SELECT ins_seq, topic_type, CASE WHEN topic_type = 'reference_only' THEN 'none' WHEN length(s) < 120 THEN 'brief' ELSE 'detailed' END AS explanation_depth, CASE topic_type WHEN 'reference_only' THEN 'reference_only' WHEN 'definition_only' THEN 'already_explained' ELSE 'needs_explanation' END AS definition_status FROM (SELECT ins_seq, s, CASE WHEN regexp_matches(lower(s), '\\b(is defined as|means|refers to)\\b') THEN 'definition_only' WHEN regexp_matches(lower(s), '\\b(for example|such as)\\b') THEN 'example' WHEN regexp_matches(lower(s), '\\b(applies|applied to|used in)\\b') THEN 'application' WHEN length(s) < 40 THEN 'reference_only' WHEN frequency_count >= 3 OR source_page = 1 THEN 'core_concept' ELSE 'sub_concept' END AS topic_type FROM (SELECT *, raw_content || {_SAID.format('ins_seq')} AS s FROM topics JOIN freq USING (book_id, topic)))", "raw topics freq")
def g05_classify_topics(spark, d):
    t = topic_table(spark, d)
    rows = t.join(topics.topic_frequency(t), ["book_id", "topic"])
    c = topics.classify(F.col("frequency_count"), F.col("source_page"), said(F.col("raw_content"), F.col("ins_seq")))
    return rows.select("ins_seq", *[column.alias(name) for name, column in c.items()])


_MENTION = f"m AS (SELECT DISTINCT book_id, s_id, w AS topic, sentence FROM (SELECT book_id, s_id, s || {_SAID.format('(ins_seq + p)')} AS sentence, unnest(list_filter(string_split_regex(s, '\\s+'), lambda x: length(x) >= 9 AND regexp_matches(x, '^[a-z]+$'))) AS w FROM (SELECT book_id, ins_seq, CAST(ins_seq AS VARCHAR) || ':' || lpad(CAST(p AS VARCHAR), 9, '0') AS s_id, s, p FROM (SELECT book_id, ins_seq, unnest(l) AS s, unnest(range(0, len(l))) AS p FROM (SELECT book_id, ins_seq, string_split(raw_content, '. ') AS l FROM topics)))))"
VIEWS["mention"] = _MENTION


def mentions(spark, d):
    """The long words of each sentence."""
    rows = topic_table(spark, d).select("book_id", "ins_seq", F.posexplode(F.split("raw_content", r"\. ")).alias("p", "s"))
    s_id = F.concat_ws(":", F.col("ins_seq").cast("string"), F.lpad(F.col("p").cast("string"), 9, "0"))
    words = F.filter(py_words(F.col("s")), lambda w: (F.length(w) >= 9) & w.rlike("^[a-z]+$"))
    return rows.select("book_id", s_id.alias("s_id"), F.explode(words).alias("topic"), said(F.col("s"), F.col("ins_seq") + F.col("p")).alias("sentence")).distinct()


@query("SELECT a.book_id, a.topic, string_agg(DISTINCT b.topic, ',' ORDER BY b.topic) AS others FROM m a JOIN m b ON a.book_id = b.book_id AND a.s_id = b.s_id AND a.topic <> b.topic GROUP BY a.book_id, a.topic", "raw topics mention")
def g06_other_topics(spark, d):
    return topics.other_topics(mentions(spark, d)).select("book_id", "topic", F.array_join("others", ",").alias("others"))


VIEWS["edge"] = "pr AS (SELECT a.book_id, a.s_id, a.sentence, a.topic AS src, b.topic AS dst, instr(lower(a.sentence), lower(a.topic)) AS p, instr(lower(b.sentence), lower(b.topic)) AS q FROM m a JOIN m b ON a.book_id = b.book_id AND a.s_id = b.s_id AND a.topic <> b.topic), edge0 AS (SELECT book_id, src, dst, row_number() OVER (PARTITION BY book_id ORDER BY s_id, p, q, src, dst) AS t, CASE WHEN regexp_matches(lower(sentence), '\\b(requires|depends on|based on)\\b') THEN 'depends_on' WHEN regexp_matches(lower(sentence), '\\b(unlike|whereas|except)\\b') THEN 'exception_to' WHEN regexp_matches(lower(sentence), '\\b(for example|such as)\\b') THEN 'example_of' WHEN regexp_matches(lower(sentence), '\\b(applies|applied to|used in)\\b') THEN 'applies' ELSE 'explains' END AS relation FROM (SELECT *, row_number() OVER (PARTITION BY book_id, least(src, dst), greatest(src, dst) ORDER BY s_id, p, q, src) AS k FROM pr WHERE p < q OR p = q AND src < dst) WHERE k = 1), leads AS (SELECT book_id, t AS t0, src AS goal, dst AS node FROM edge0 UNION SELECT l.book_id, l.t0, l.goal, e.dst FROM leads l JOIN edge0 e ON e.book_id = l.book_id AND e.src = l.node AND e.t < l.t0 WHERE l.node <> l.goal), edge AS (SELECT book_id, src, dst, relation FROM edge0 WHERE (book_id, t) NOT IN (SELECT (book_id, t0) FROM leads WHERE node = goal))"


VIEWS["stem"] = _MENTION.replace("w AS topic", "left(w, 3) AS topic")


def stems(spark, d):
    """The mentions by the first letters of the words, which recur: their relations have cycles."""
    return mentions(spark, d).withColumn("topic", F.left("topic", F.lit(3))).distinct()


@query("SELECT * FROM edge", "raw topics stem edge")
def g07_map_relationships(spark, d):
    return topics.map_relationships(stems(spark, d))


@query("SELECT m.book_id, m.topic, coalesce(any_value(context), 'None identified.') AS context FROM m LEFT JOIN (SELECT book_id, src AS topic, string_agg(dst || ' (' || relation || ')', ', ' ORDER BY dst) AS context FROM edge GROUP BY book_id, src) c ON m.book_id = c.book_id AND m.topic = c.topic GROUP BY m.book_id, m.topic", "raw topics stem edge")
def g08_relationship_context(spark, d):
    m = stems(spark, d)
    return topics.relationship_context(topics.map_relationships(m), m)


def registry(spark, d):
    t = topic_table(spark, d)
    old = t.where("source_page % 2 = 1").select(F.lower("topic").alias("topic_key"), F.lit("old").alias("canonical_name"), F.lit("brief").alias("explanation_depth"), F.lit("{}").alias("metadata"), F.lit(True).alias("explained"), F.col("ins_seq").alias("version")).dropDuplicates(["topic_key"])
    return topics.register_topics(old, t.where("source_page % 2 = 0").select(F.col("topic").alias("name"), F.lit("detailed").alias("depth"), F.col("ins_seq").alias("version")))


VIEWS["registry"] = "registry AS (SELECT k AS topic_key, coalesce(n, 'old') AS canonical_name, CASE WHEN n IS NULL THEN 'brief' ELSE 'detailed' END AS explanation_depth FROM (SELECT k, arg_max(topic, ins_seq) FILTER (WHERE source_page % 2 = 0) AS n FROM (SELECT *, lower(topic) AS k FROM topics) GROUP BY k))"


@query("SELECT * FROM registry", "raw topics registry")
def g09_register_topics(spark, d):
    return registry(spark, d).select("topic_key", "canonical_name", "explanation_depth")


@query("SELECT ins_seq, topic_key IS NOT NULL AS explained FROM topics LEFT JOIN registry ON lower(topic) = topic_key", "raw topics registry")
def g10_is_explained(spark, d):
    return topics.is_explained(topic_table(spark, d).select("ins_seq", F.col("topic").alias("name")), registry(spark, d)).select("ins_seq", "explained")


@query("SELECT ins_seq, explanation_depth AS depth FROM topics LEFT JOIN registry ON lower(topic) = topic_key", "raw topics registry")
def g11_get_explanation_depth(spark, d):
    return topics.explanation_depth(topic_table(spark, d).select("ins_seq", F.col("topic").alias("name")), registry(spark, d)).select("ins_seq", "depth")


# --- V: vectors ----------------------------------------------------------


def asked_vectors(spark, d):
    return _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_PAIRS = "(SELECT q.vec_id AS query_id, v.vec_id, round({}, 9) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v)"


@query()
def v01_embed(spark, d):
    out = vectors.embed(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query(f"SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS k FROM {_PAIRS.format('list_cosine_similarity(q.e, v.e)')} WHERE x IS NOT NULL AND NOT isnan(x)) WHERE k <= 10")
def v02_cosine_scores(spark, d):
    return vectors.cosine_scores(asked_vectors(spark, d), _t(spark, d, "embeddings"), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, round(x, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS k FROM {_PAIRS.format('pow(list_distance(q.e, v.e), 2)')}) WHERE k <= 5")
def v03_knn_l2(spark, d):
    return vectors.knn_l2(asked_vectors(spark, d), _t(spark, d, "embeddings"), 5).withColumn("distance", F.round("distance", 5))
