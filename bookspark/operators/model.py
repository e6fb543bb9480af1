"""Calls of a language model as a batch job: prompts, answers, checks, retries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.session import cut, importable

#: Generation settings by task (temperature, top_p, top_k, most tokens), null where the model decides; other tasks get the first.
SETTINGS = {
    "default": (0.1, 1.0, 1, None),
    "structure": (0.1, None, None, 30000),
    "mapping": (0.1, None, None, 30000),
    "consolidate": (0.2, None, None, 45000),
    "notes": (0.7, None, None, 30000),
    "rewrite_node": (0.7, None, None, 30000),
    "questions": (0.1, None, None, None),
    "answer": (0.2, None, None, None),
}


def build_prompt(template: str, **slots: Column) -> Column:
    """The template with each {slot} filled once; values are never searched for slots again.

    Give structs, arrays and maps as JSON (to_json); booleans become true and false, nulls empty.
    """
    import re

    parts: list[Column] = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(F.coalesce(slots[piece].cast("string"), F.lit("")) if k % 2 else F.lit(piece))
    return F.concat(*parts)


def settings(spark: SparkSession) -> DataFrame:
    rows = [(task, *values) for task, values in SETTINGS.items()]
    return spark.createDataFrame(rows, "task string, temperature double, top_p double, top_k int, max_tokens int")


def with_settings(prompts: DataFrame) -> DataFrame:
    """prompts(task) with their task's settings; the table is a handful of rows."""
    known = F.coalesce(F.col("task"), F.lit("")).isin(*SETTINGS)
    named = prompts.withColumn("__task", F.when(known, F.col("task")).otherwise("default"))
    return named.join(F.broadcast(settings(prompts.sparkSession).withColumnRenamed("task", "__task")), "__task").drop("__task")


def echo(prompts: list[str], config: dict) -> list[str]:
    """The deterministic default: the prompt's last line."""
    return [p.rsplit("\n", 1)[-1] for p in prompts]


def generate(prompts: DataFrame, function: Callable[[list[str], dict], list[str]] = echo, config: dict | None = None, prompt: str = "prompt") -> DataFrame:
    """prompts with answer and error; a failed batch is tried row by row, and a failed row has an empty answer."""
    kept = [c for c in prompts.columns if c not in ("answer", "error")]
    schema = prompts.select(*kept).schema.add("answer", "string").add("error", "string")
    config = config or {}

    def one(p: str) -> tuple[str, str | None]:
        try:
            return function([p], config)[0] or "", None
        except Exception as e:
            return "", f"{type(e).__name__}: {e}"[:200]

    def run(batches):
        for pdf in batches:
            texts = pdf[prompt].fillna("").tolist()
            try:
                answers = function(texts, config)
                if len(answers) != len(texts):
                    raise ValueError("the model gave another number of answers")
                rows = [(a or "", None) for a in answers]
            except Exception:
                rows = [one(p) for p in texts]
            yield pdf.assign(answer=pd.Series([r[0] for r in rows], index=pdf.index, dtype=object), error=pd.Series([r[1] for r in rows], index=pdf.index, dtype=object))

    importable(prompts.sparkSession)
    return prompts.select(*kept).mapInPandas(run, schema)


def unfenced(answer: Column) -> Column:
    """An answer without a leading code fence and what follows its end."""
    c = F.regexp_replace(answer, r"\A\s+|\s+\z", "")
    c = F.when(c.startswith("```json"), F.split_part(F.substr(c, F.lit(8)), F.lit("```"), F.lit(1))).when(c.startswith("```"), F.split_part(F.substr(c, F.lit(4)), F.lit("```"), F.lit(1))).otherwise(c)
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def parse_answer(answers: DataFrame, required: dict[str, list[str] | None], answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) of JSON answers: string fields that must be there, some from closed vocabularies.

    good has a column a field; quarantine has the reason.
    """
    rows = answers.withColumn("__v", F.try_parse_json(unfenced(F.col(answer))))
    reason = F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, "empty").when(F.col("__v").isNull(), "not JSON").when(~F.schema_of_variant("__v").startswith("OBJECT"), "not an object")
    for name, allowed in required.items():
        kind = F.schema_of_variant(F.try_variant_get("__v", f"$.{name}", "variant"))
        value = F.try_variant_get("__v", f"$.{name}", "string")
        reason = reason.when(kind.isNull() | (kind == "VOID"), f"{name} is missing").when(kind != "STRING", f"{name} is not a string")
        if allowed:
            reason = reason.when(~value.isin(*allowed), f"{name} is not allowed")
    rows = rows.withColumn("reason", reason)
    values = {n: F.try_variant_get("__v", f"$.{n}", "string") for n in required}
    return rows.where("reason is null").withColumns(values).drop("__v", "reason"), rows.where("reason is not null").drop("__v")


def parse_string_list(answer: Column, source: Column) -> Column:
    """An answer's JSON list of strings; on failure the first 100 characters of the source as its one item."""
    plain = F.replace(F.replace(answer, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    v = F.try_parse_json(plain)
    ok = F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(ok, F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(F.substring(source, 1, 100)))


def retry_then_fail(prompts: DataFrame, function: Callable, good: Column, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answered, failed): rows whose answer isn't good are tried again, up to `attempts` times.

    Each attempt's answers are kept, so that a model that varies is asked once.
    """
    left, done = prompts, None
    for k in range(attempts):
        tried = cut(generate(left, function, {"attempt": k + 1}))
        now = tried.where(good)
        done = now if done is None else done.unionByName(now)
        left = tried.where(~F.coalesce(good, F.lit(False))).drop("answer", "error")
    return done, left


def default_on_failure(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)
