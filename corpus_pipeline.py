"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, leaks of the benchmark go,
personal data gets surrogates, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the scratch folder
and hands the table to the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encoding_digests
from tidemark.llm.common import table, write_table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.jaccard_join import keep_one_of_each
from tidemark.llm.pii import with_surrogates
from tidemark.llm.queries import SURROGATE_KEY, tokenizer_path
from tidemark.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches 0.7."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of texts with a 5-word shingle similarity of 0.8 or more."""
    return keep_one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold 80 % or more of the 5-word shingles of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates in place of personal data; no document goes."""
    return with_surrogates(docs, SURROGATE_KEY)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, of each document."""
    return encoding_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn a model and draw keyed surrogates, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL: str | None = None
