"""The registered queries of this subpackage: thin digests of the operators' results, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.llm import bpe, decontaminate, fim, hardneg, langid, lines, pagetext, pii, pulearn, quality, simhash, toxicity, warc
from bookspark.llm._shared import cut, prepare, small, table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(folds: int = 4, fold: int = 2):
    """crc32(doc_id as text) mod `folds` is `fold`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    marked = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hits()
    names = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count(F.col("base_spans"), kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents.where(~held_out()))
    out = langid.identify(documents.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = pagetext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(documents.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5, 0).alias("held_out"))
    featured = cut(pulearn.featurize(documents).drop("text"))
    trusted = cut(table(spark, sf_dir, "labels").where(~held_out(5, 0) & (F.col("quality") == 1)).select("doc_id").distinct())
    rows = featured.where("not held_out").join(small(trusted).withColumn("positive", F.lit(True)), "doc_id", "left")
    return pulearn.score(featured, pulearn.train(rows)).select("doc_id", "held_out", "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.col("form") == fim.PLAIN
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", F.when(~plain, F.col("cut_1")).alias("prefix_chars"), F.when(~plain, F.col("cut_2") - F.col("cut_1")).alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_pii, op3_bpe, op4_language_id, op5_line_dedup, op6_html, op7_simhash, op8_toxicity, op9_quality, op10_warc, op11_quality_pu, op12_fill_in_middle, op13_hard_negatives)}
