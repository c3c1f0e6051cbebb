"""The corpus pipeline: five stages over documents, each an operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns it got, the last one with the training
order beside them; ``run`` and the cluster write its rows as Parquet and read them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import read, saved
from factorloom.llm.decontamination import without_contaminated
from factorloom.llm.jaccard import one_of_each
from factorloom.llm.lines import drop_repeated_lines
from factorloom.llm.mixing import training_order
from factorloom.llm.toxicity import is_held_out, train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more; learned from the labels of these documents."""
    model = train(docs, read(spark, sf_dir, "labels"), usable=~is_held_out())
    return without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of two lines or more; every document stays, n_chars follows its text."""
    kept = drop_repeated_lines(docs)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of documents linked by five-word shingles of similarity 0.8 or more."""
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones too."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, with what the mix takes of each: a row for each time that one is read, by position; those never read at the end."""
    return training_order(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard", jaccard), ("decontamination", decontamination), ("mixing", mixing)]

#: Trained trees, near duplicates by set similarity and slot consistency are beyond SQL; tests/llm/test_pipeline.py compares run() with plain Python on planted texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
