"""A corpus clean-up: documents through five operators of ``duskwatch.llm``, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All stages but the last return the columns of ``docs``; where a
stage changes ``text``, ``n_chars`` follows. Stages take null, empty and repeated rows, empty
tables and further columns as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import decontaminate, jaccard, lines, pieces, quality
from duskwatch.llm.queries import PIECE_MODEL
from duskwatch.plans.telemetry import table
from duskwatch.session import Shelf


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good_lines_and_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that fail the base figures or lose too much go."""
    return _recount(quality.keep_good(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out; a document that had nothing else goes."""
    return _recount(lines.without_repeats(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 over five-word shingles, the one with the smallest doc_id."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, exact): the piece numbers of every text, and whether they decode to it."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    both = pieces.decode(pieces.encode(own, PIECE_MODEL), PIECE_MODEL)
    return both.select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids",
                       (F.xxhash64("decoded") == F.col("text_key")).alias("exact"))


STAGES = [
    ("quality rules", keep_good_lines_and_documents),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_text),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: The last stage (pieces by best path) and the components of the third have no plain SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = shelf.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
