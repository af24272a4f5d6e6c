"""Registered queries: every operator of this subpackage over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.telemetry import table
from . import compression, decontaminate, infill, jaccard, language, licenses, lines, packing, pieces, pseudonyms, quality, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


#: The rules of the query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


#: The public piece model of the query; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    both = pieces.decode(pieces.encode(docs, PIECE_MODEL), PIECE_MODEL)
    return both.select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids",
                       (F.xxhash64("decoded") == F.col("text_key")).alias("exact"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    return compression.score(docs, model).select(
        "doc_id", compression.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", compression.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: The key of the query; a deployment takes its own from its secret store.
PSEUDONYM_KEY = "key of the registered query"


@query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return docs.select("doc_id", F.size("replaced").cast("long").alias("n_replaced"),
                       *(pseudonyms.count_of(k).alias(f"n_{k}") for k in pseudonyms.KINDS), "text")


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("families").cast("long").alias("n_families"), F.array_join("families", ",").alias("families"),
                        F.coalesce(F.array_size("spans"), F.lit(0)).cast("long").alias("n_paragraphs"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.quantized(table(spark, sf_dir, "embeddings"))
    found = whitening.whiten(rows, whitening.fit(rows))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part")
    return found.select("id", "n", "deviation", "identity_error", parts).select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        "part.whitened", "part.explained", "identity_error")


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rank file of the vocabulary byte_bpe_50k.json; tests hold its ids equal to those of that file.
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                        digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
