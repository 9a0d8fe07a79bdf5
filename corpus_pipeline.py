"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage works on all rows that the one before kept, and all but the last return the columns of
documents. Near duplicates are judged by sets of five words at a similarity of 0.8.

What holds for all stages: columns beyond doc_id and text pass through untouched, also where they are named like a column
that the stage's operator makes; null ids are allowed, and order before all others; a null text has no words; very long texts are
taken whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm import decontaminate, jaccard, pieces, quality, substrings
from fathomark.llm.common import clearing, remove, scratch, session_batches, table


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over docs whose columns beyond id and text have names that clash with none, and get theirs back afterwards."""
    session_batches(docs.sparkSession)
    others = {c: f"_column_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = work(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in others.items())))
    return found.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go.

    Null, empty and short texts are rejected (they have too few words); what measures just at a limit stays; repeated rows
    are judged each by itself, and alike.
    """
    return apart(docs, lambda d: quality.apply_policy(quality.ledger(d), "web-1").where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Of rows alike in id and text that stays whose other columns sort first; rows of one id and different texts, and rows with
    null ids, are documents of their own, in the order of id and text; null and wordless texts have no shingles, are
    near duplicates of nothing, and stay.
    """
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        once = docs.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_o"))
        docs = once.select(*(c if c in ("doc_id", "text") else F.col(f"_o.`{c}`") for c in docs.columns))
    return apart(docs, lambda d: jaccard.jaccard_components(d, width=5, percent=80).where("first_of_component"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start earlier elsewhere are cut out, with n_chars (where there is one) brought up to date; documents of which nothing is left go.

    Null and wordless texts lose nothing and stay; rows alike in id and text are one document and lose the same words; rows of one
    id and different texts, and null ids, come in the order of id and text.
    """
    place = next((f"_column_{k}" for k, c in enumerate(docs.columns) if c == "n_chars"), None)

    def work(d: DataFrame) -> DataFrame:
        found = substrings.dedup_substrings(d, replace=True).where("n_removed = 0 or n_removed < n_words")
        return found.withColumn(place, F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(place))) if place else found

    return apart(docs, work)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and wordless texts hold none and stay; repeated rows are judged each by itself, and alike; items without a text or a word
    are no passage, items without an id are; without items all documents stay.
    """
    return apart(docs, lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, and whether they decode to its text.

    Null and empty texts have no ids; rows with a null id are of variant 0; repeated rows get the same ids; columns named like one
    that this stage adds are replaced.
    """
    import public_tokenizers

    session_batches(spark)
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: The last stage draws merges by a keyed hash, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables go when its output is written, and that when the next one's is; the last stage's input stays, for the caller to read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        with clearing(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
