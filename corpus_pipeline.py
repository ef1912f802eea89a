"""From raw documents to token ids: toxicity, line dedup, near dedup, mixing, encoding.

Every stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the columns of the documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewire.llm import line_dedup, mixing, near_dedup, toxicity  # noqa: E402
from tidewire.llm.queries import bpe_digests  # noqa: E402
from tidewire.llm.text import documents  # noqa: E402
from tidewire.session import settle  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the learned lexicon rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Later copies of repeated stretches of ten words or more go; every document stays, with what is left of its text."""
    left = line_dedup.cleaned(docs, joined=True)
    kinds = dict(docs.dtypes)
    return left.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row as often as the mix takes its document."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded bytes."""
    return bpe_digests(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# A learned lexicon and ranked merges are beyond SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents of ``folder``; each result is stored before the next stage reads it."""
    docs = documents(spark, folder)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if place < len(STAGES) - 1:
            docs = settle(docs)
    return docs
