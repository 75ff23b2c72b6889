"""A corpus from raw documents to packed sequences: each stage calls one operator of quire.llm on all rows the last one kept.

Defined cases, for every stage: an empty table gives an empty one; repeated rows, rows without an id and nulls in any column
are taken as they come; very long texts are read whole; columns that the stage doesn't need stay as they are, whatever
their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import op3_pii, op4_langid, op5_packing, op7_jaccard, op10_mixing
from quire.session import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned.

    Null and empty texts, texts without a letter, and texts that are mostly n-grams of no learned text go. With no lang to learn
    from, all go."""
    return op4_langid.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the least id.

    Rows of one id are told apart by their sets of shingles; a class without any id keeps one row; texts without words are no
    copies of each other."""
    return op7_jaccard.stage(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind. No row goes; null stays null; n_chars is that of the new text."""
    return op3_pii.stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: a row for each time a document is taken. Texts without words are never taken; ties in a
    source's order go by id, then size."""
    return op10_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece. A null or empty text is its end id alone."""
    return op5_packing.query(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: Language identification, shingle classes and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written and read again, so no later stage redoes an earlier one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
