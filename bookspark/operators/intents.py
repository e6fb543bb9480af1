"""Requests of users as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions import py_strip

FIELDS = ("task_type", "scope", "depth", "language_level", "format_type", "allow_external_knowledge", "normalized_query")
#: The vocabularies of a classification.
TASKS = ("rewrite_book", "summarize_book", "study_notes", "revision_notes", "question_answer")
SCOPES = ("full_book", "specific_topic", "single_question")
LENGTHS = ("very_short", "short", "medium", "detailed")
LEVELS = ("simple", "standard", "advanced")
FORMATS = ("paragraph", "bullet", "exam_oriented")
#: What a request means when its classification failed, and the intents that commands imply; a null query is the request's own.
FALLBACK = ("question_answer", "single_question", "medium", "standard", "paragraph", True, None)
DEFAULTS = {
    "rewrite": ("rewrite_book", "full_book", "medium", "standard", "paragraph", False, "rewrite book"),
    "export": ("rewrite_book", "full_book", "medium", "standard", "exam_oriented", False, "rewrite book"),
    "ask": ("question_answer", "single_question", "medium", "standard", "paragraph", False, None),
}


def fixed_command(text: Column) -> Column:
    """exit, help or export; null for anything else and for empty input."""
    word = F.lower(py_strip(text))
    return F.when(word.isin("exit", "quit"), "exit").when(word.isin("help", "export"), word)


def clean_path(text: Column) -> Column:
    c = F.regexp_replace(py_strip(text), r'\A"+|"+\z', "")
    return F.regexp_replace(F.regexp_replace(c, r"\A'+|'+\z", ""), "[\r\n]", "")


def ingest_requests(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """inputs with path and is_ingest: a .pdf path that looks absolute or is among files(path)."""
    rows = inputs.withColumn("path", clean_path(F.col("text")))
    known = files.select("path").distinct().withColumn("__known", F.lit(True))
    pdf = F.lower("path").endswith(".pdf")
    absolute = F.col("path").contains(":") & F.col("path").contains("\\")
    return rows.join(known, "path", "left").withColumn("is_ingest", F.coalesce(pdf & (absolute | F.coalesce("__known", F.lit(False))), F.lit(False))).drop("__known")


def classify_intent(text: Column) -> dict[str, Column]:
    """The default rules of classification, by keyword; each field from a closed vocabulary."""
    low = F.lower(text)
    has = lambda *words: low.rlike(r"\b(" + "|".join(words) + r")\b")
    task = F.when(has("summary", "summarize", "summarise"), "summarize_book").when(has("revision"), "revision_notes").when(has("notes"), "study_notes").when(has("rewrite"), "rewrite_book").otherwise("question_answer")
    whole = has("book", "everything", "all chapters")
    return {
        "task_type": task,
        "scope": F.when(task == "question_answer", "single_question").when(whole, "full_book").otherwise("specific_topic"),
        "depth": F.when(has("very short"), "very_short").when(has("brief", "short"), "short").when(has("detailed", "detail"), "detailed").otherwise("medium"),
        "language_level": F.when(has("simple", "easy"), "simple").when(has("advanced"), "advanced").otherwise("standard"),
        "format_type": F.when(has("points", "bullet", "bullets", "list"), "bullet").when(has("exam"), "exam_oriented").otherwise("paragraph"),
        "allow_external_knowledge": F.lit(True), "normalized_query": py_strip(text),
    }


def _given(values: tuple, text: Column) -> dict[str, Column]:
    return {k: text if k == "normalized_query" and v is None else F.lit(v) for k, v in zip(FIELDS, values)}


def fallback_intent(text: Column) -> dict[str, Column]:
    """What a request means when its classification failed."""
    return _given(FALLBACK, text)


def with_fallback(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows whose intent fields are null as a whole get the fallback."""
    missing = F.col("task_type").isNull()
    other = fallback_intent(F.col(text))
    return rows.withColumns({f: F.when(missing, other[f]).otherwise(F.col(f)) for f in FIELDS})


def default_intent(kind: str, text: Column | None = None) -> dict[str, Column]:
    """The intent of a command; `text` is the question of `ask`."""
    return _given(DEFAULTS[kind], F.lit(None).cast("string") if text is None else text)


def legacy_rewrite_intent(argument: Column) -> dict[str, Column]:
    """The intent of a bare rewrite command: of the whole book for `book` or no argument, else of a topic."""
    word = F.coalesce(argument, F.lit("book"))
    own = default_intent("rewrite")
    return own | {"scope": F.when(word == "book", "full_book").otherwise("specific_topic"), "normalized_query": F.concat(F.lit("rewrite "), word)}


def route_intent(intents: DataFrame, books: DataFrame) -> DataFrame:
    """intents with route: refused for a whole book that isn't there, else rewrite or retrieve."""
    known = books.select("book_id").distinct().withColumn("__known", F.lit(True))
    whole = F.col("scope") == "full_book"
    route = F.when(whole & F.col("__known").isNull(), "refused").when(whole, "rewrite").otherwise("retrieve")
    return intents.join(known, "book_id", "left").withColumn("route", route).drop("__known")
