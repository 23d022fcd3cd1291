"""A corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language_id, near_dedup, packing, substring_dedup
from corvane.llm.queries import vocabulary_path
from corvane.llm.shared import cut, held_out, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go. lang stays as it is given."""
    dictionaries = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    tagged = docs.select(*(F.col(c).alias(c if c == "text" else f"_own_{c}") for c in docs.columns))
    kept = language_id.classify(tagged, dictionaries).where("accepted")
    return kept.select(*(F.col(c if c == "text" else f"_own_{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group linked by 0.8 of their five-word shingles or more."""
    return near_dedup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 50 words or more that a document with a smaller doc_id has too."""
    return substring_dedup.remove_repeats(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 10 consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: The first stage's compression classifier can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
