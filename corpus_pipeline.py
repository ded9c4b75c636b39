"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Defined results, stage by stage: null, empty and word-free texts are never
toxic by any word, have no near duplicate and no benchmark passage, and so
pass the first three stages; they have no words to mix and end there.  Rows
that repeat are judged alike, one of them stays at the near-duplicate stage,
and rows without an id all stay there.  An empty table passes as an empty
table, without labels nothing is rejected, and an empty benchmark marks
nothing.  Further columns, whatever their names, are kept by all but the last
stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrata.llm._spark import remove, shared_folder, tables
from kestrata.llm.decontam import decontaminated
from kestrata.llm.mixing import mixed_documents
from kestrata.llm.ngram_join import one_of_each
from kestrata.llm.sharding import interleave
from kestrata.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, tables(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, linked at a Jaccard similarity of 0.8."""
    return one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two benchmark items or more go; from others the passages are cut out."""
    return decontaminated(docs, tables(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, in up to three passes."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return interleave(docs, 24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier takes part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    folder, done = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:  # what the next stage was made from
            remove(spark, done)
        done = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
