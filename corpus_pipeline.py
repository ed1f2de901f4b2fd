"""The corpus pipeline: language, lines, near duplicates, repeats, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import language_id, line_dedup, ngram_join, packing, substring_dedup
from tallyweave.llm.common import read, stash

#: Words of a passage that counts as a repeat in the pipeline.
REPEAT_WORDS = 50


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the stage's input; n_chars follows the text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`")
                         for c in columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; profiles come from the labelled rows of the input."""
    return language_id.drop_foreign(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of three lines that came earlier are cut; all documents stay."""
    return _with_length(line_dedup.drop_repeated_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the least doc_id stays."""
    return ngram_join.keep_first_of_group(docs, width=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of REPEAT_WORDS words or more that came earlier are cut; all documents stay."""
    return _with_length(substring_dedup.drop_repeats(docs, REPEAT_WORDS), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Packing and recompression have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs)
    return docs
