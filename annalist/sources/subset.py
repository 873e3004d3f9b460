"""Persistent subsets of a database."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.columns import SUBJECT
from annalist.operators.timeline import missing_subjects, select_subjects
from annalist.sources import files
from annalist.sources.convert import read_header, write_header, write_tables
from annalist.sources.sizes import by_range, database_tasks


def read_id_file(spark: SparkSession, path: str) -> DataFrame:
    """Ids from files of little-endian 64-bit integers, which Hadoop's format of fixed-length records cuts to tasks."""

    def run(records: Iterator[bytes]) -> Iterator[tuple[int]]:
        while some := b"".join(itertools.islice(records, 1 << 16)):
            yield from ((i,) for i in np.frombuffer(some, "<i8").tolist())

    return spark.createDataFrame(spark.sparkContext.binaryRecords(path, 8).mapPartitions(run), f"{SUBJECT} bigint")


def as_ids(spark: SparkSession, ids: DataFrame | Sequence[int] | np.ndarray | str) -> DataFrame:
    """Distinct ids from a table (its first column), a sequence, or the path of an id file."""
    if isinstance(ids, str):
        found = read_id_file(spark, ids)
    elif isinstance(ids, DataFrame):
        found = ids.select(F.col(ids.columns[0]).cast("bigint").alias(SUBJECT))
    else:
        found = spark.createDataFrame([(int(i),) for i in ids], f"{SUBJECT} bigint")
    return found.distinct()


def write_subset(spark: SparkSession, source: str, target: str, ids: DataFrame | Sequence[int] | np.ndarray | str) -> None:
    """Writes the database of the given subjects, each of which has to exist. The files stay clustered and sorted:
    a semi-join that broadcasts keeps the scan's order, any other is dealt and sorted again."""
    if files.exists(spark, target):
        raise FileExistsError(target)
    properties = read_header(spark, source)
    wanted, subjects = as_ids(spark, ids), spark.read.parquet(f"{source}/subjects")
    missing = [r[0] for r in missing_subjects(wanted, subjects).orderBy(SUBJECT).limit(5).collect()]
    if missing:
        raise KeyError(f"Could not find subject_id {', '.join(map(str, missing))}")
    chosen = select_subjects(spark.read.parquet(f"{source}/events"), wanted)
    parts = database_tasks(spark, source, select_subjects(subjects, wanted))
    write_tables(by_range(chosen, parts, SUBJECT).sortWithinPartitions(SUBJECT, "event_index"), target, "errorifexists", parts)
    write_header(spark, target, properties, "errorifexists")
    if files.exists(spark, f"{source}/metadata"):
        files.copy_tree(spark, f"{source}/metadata", f"{target}/metadata")
