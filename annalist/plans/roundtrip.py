"""The customer timeline as files: a dataset, its database, rewritten and cut ones.

A session writes each of them once for a folder of tables and reads it as often as queries ask.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.database import SubjectDatabase
from annalist.functions.columns import SUBJECT
from annalist.plans.timeline import raw_events
from annalist.sources import files
from annalist.sources.convert import convert
from annalist.sources.dataset import check_schemas, data_files, read_dataset
from annalist.sources.schema import spark_schema
from annalist.sources.sizes import by_range, tasks
from annalist.sources.subset import write_subset
from annalist.transform import transform_dataset
from annalist.verify import differences

_made: dict[tuple[str, ...], str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can write: below the session's checkpoint folder. Only a session on one
    machine may have none, and gets a temporary one, which goes when Python ends."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="annalist-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared}/files-{uuid.uuid4().hex}"


def once(spark: SparkSession, make: Callable[[str], None], *key: str) -> str:
    """The folder that `make` has written for the key in this session."""
    at = (spark.sparkContext.applicationId, *key)
    if at not in _made:
        folder = work_folder(spark)
        make(folder)
        _made[at] = folder
    return _made[at]


def write_rows(rows: DataFrame, folder: str, metadata: dict) -> None:
    """A dataset of rows with src_id: a subject's rows stand together, in order, in one file."""
    dealt = by_range(rows, tasks(rows.count()), SUBJECT).sortWithinPartitions(SUBJECT, F.col("time").asc_nulls_first(), F.col("src_id").asc_nulls_first())
    dealt.write.option("compression", "zstd").parquet(f"{folder}/data")
    files.write_bytes(rows.sparkSession, f"{folder}/metadata/dataset.json", json.dumps(metadata).encode())


def timeline_dataset(spark: SparkSession, sf_dir: str) -> str:
    def make(folder: str) -> None:
        n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
        write_rows(raw_events(spark, sf_dir), folder, {"tables": ["customer", "orders"], "n_customers": n})

    return once(spark, make, "dataset", sf_dir)


def timeline_database(spark: SparkSession, sf_dir: str, num_threads: int = 4) -> SubjectDatabase:
    source = timeline_dataset(spark, sf_dir)
    return SubjectDatabase(once(spark, lambda folder: convert(spark, source, folder, dictionaries=("code",)), "database", sf_dir), num_threads, spark)


def rewritten_dataset(spark: SparkSession, sf_dir: str, name: str, change: Callable) -> str:
    """The dataset rewritten subject by subject by a function that the name stands for."""
    source = timeline_dataset(spark, sf_dir)
    return once(spark, lambda folder: transform_dataset(source, folder, change, 4, spark), "rewritten", sf_dir, name)


def rewritten_rows(spark: SparkSession, sf_dir: str, name: str, change: Callable) -> DataFrame:
    return read_dataset(spark, rewritten_dataset(spark, sf_dir, name, change))


def scaled_database(spark: SparkSession, sf_dir: str, factor: int = 10) -> SubjectDatabase:
    """The database of a dataset rewritten subject by subject."""

    def scaled(subject):
        subject.subject_id *= factor
        return subject

    source = rewritten_dataset(spark, sf_dir, f"scaled {factor}", scaled)
    return SubjectDatabase(once(spark, lambda folder: convert(spark, source, folder), "scaled", sf_dir, str(factor)), 4, spark)


def cut_database(spark: SparkSession, sf_dir: str, ids: list[int]) -> SubjectDatabase:
    source = timeline_database(spark, sf_dir).path_to_database
    return SubjectDatabase(once(spark, lambda folder: write_subset(spark, source, folder, ids), "cut", sf_dir, str(ids)), 4, spark)


def cut_by_file(spark: SparkSession, sf_dir: str, every: int, rest: int) -> SubjectDatabase:
    """The subjects whose ids leave a rest, by a file of their ids in falling order."""
    database = timeline_database(spark, sf_dir)

    def make(folder: str) -> None:
        ids = sorted((i for i in database if i % every == rest), reverse=True)
        files.write_bytes(spark, f"{folder}-ids/ids", struct.pack(f"<{len(ids)}q", *ids))
        write_subset(spark, database.path_to_database, folder, f"{folder}-ids/ids")

    return SubjectDatabase(once(spark, make, "cut by file", sf_dir, str(every), str(rest)), 4, spark)


def ancient_database(spark: SparkSession, sf_dir: str) -> SubjectDatabase:
    """Orders long before 1970, entered another time before, a microsecond off the full second."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(
        F.col("o_custkey").alias(SUBJECT),
        (F.col("o_orderdate") - F.expr("INTERVAL '40000' DAY")).alias("time"),
        F.lit("ORDER").alias("code"),
        (F.col("o_orderdate") - F.expr("INTERVAL '50000' DAY") - F.expr("INTERVAL '0.000001' SECOND")).alias("entered"),
        F.col("o_orderkey").alias("src_id"),
    )

    def make(folder: str) -> None:
        write_rows(rows, f"{folder}-dataset", {})
        convert(spark, f"{folder}-dataset", folder)

    return SubjectDatabase(once(spark, make, "ancient", sf_dir), 4, spark)


def differing_events(spark: SparkSession, sf_dir: str, one_in: int = 1) -> DataFrame:
    """The database against a dataset without some subjects and with other values for some orders."""
    rows = raw_events(spark, sf_dir).where(F.col(SUBJECT) % 11 != 0)
    changed = rows.withColumn("numeric_value", F.when(F.col("src_id") % 5 == 0, F.col("numeric_value") + 1).otherwise(F.col("numeric_value")))
    source = once(spark, lambda folder: write_rows(changed, folder, {}), "differing", sf_dir)
    schema = spark_schema(check_schemas(spark, data_files(spark, source)))
    return differences(spark, source, timeline_database(spark, sf_dir).path_to_database, schema, one_in)


def mapped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a function gives for each of four parts of the subjects."""

    def summary(subjects):
        n_subjects, n_events, ids = 0, 0, []
        for s in subjects:
            n_subjects, n_events = n_subjects + 1, n_events + len(s.events)
            ids = [min(*ids, s.subject_id), max(*ids, s.subject_id)] if ids else [s.subject_id] * 2
        return (n_subjects, *ids, n_events) if ids else None

    rows = [(k + 1, *r) for k, r in enumerate(timeline_database(spark, sf_dir).map(summary, properties=["code"])) if r]
    return spark.createDataFrame(rows, "part bigint, n_subjects bigint, lo bigint, hi bigint, n_events bigint")


def mapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urgent orders, and all events before them, summed by a function of subjects and their orders for each part."""

    def count(pairs):
        n_rows = n_prior = 0
        for s, rows in pairs:
            n_rows += len(rows)
            n_prior += sum(e.time is not None and e.time < r.cutoff for r in rows for e in s.events)
        return n_rows, n_prior

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderpriority").startswith("1"))
    side = orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("cutoff"))
    parts = list(timeline_database(spark, sf_dir).map_with_data(count, side, properties=["time"]))
    return spark.createDataFrame(parts, "n_rows bigint, n_prior bigint").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_prior").alias("n_prior"))
