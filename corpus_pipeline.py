"""A training corpus from raw documents: language, near copies, benchmark leaks, personal data, mixture.

Each stage reads the Parquet table that the one before has written, and works on all of it. Defined results, beside those
of the operators: documents with a null, empty or letterless text go in the first stage; of a group of near copies the
document with the least doc_id stays, with all its rows where the id is repeated, and rows without a doc_id all stay;
equal texts are near copies of each other; texts of any length are read whole; a null source is a source of its own;
an empty table gives no rows; further columns, whatever their names, are kept by all stages but the last, which returns
doc_id, source, size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import decontaminate, jaccard, language, mixture, pii
from annalist.llm.learning import held_out
from annalist.llm.shared import removed, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be identified go."""
    return language.keep_identified(docs, language.train(docs, ~held_out()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.Threshold(percent=80, words=5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact_documents(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixture.mix_sources(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
]

#: The stages before the last are not expressible in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = written(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(folder)
        if read:
            removed(spark, read)
        read = folder
    return STAGES[-1][1](spark, docs, sf_dir)
