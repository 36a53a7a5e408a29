"""A training corpus from documents: language, near-duplicates, repeated passages, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; between stages the rows are written as Parquet
in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm.common import discard, discarding, fresh, table
from basinflow.llm.language import UNDETERMINED, identify
from basinflow.llm.near_copies import keep_one_of_each
from basinflow.llm.packing import pack_documents
from basinflow.llm.pii import sanitize
from basinflow.llm.substrings import remove_repeats
from basinflow.session import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    name, score = fresh(docs.columns, "language", "margin")
    found = identify(docs, names=(name, score))
    return found.where(F.col(name) != UNDETERMINED).drop(name, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: SimHash, and beyond its reach MinHash, of five-word shingles at 0.8 or more."""
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go."""
    return remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced by their kind."""
    return sanitize(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Models, automata and hashes of this pipeline are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, path = docs, scratch(spark, "table")
        with discarding(spark):
            stage(spark, before, sf_dir).write.parquet(path)
        docs = spark.read.schema(before.schema).parquet(path)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
