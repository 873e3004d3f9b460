"""The database sink: events clustered by subject, an index of subjects, a header, the metadata files.

    <target>/events/    parquet, zstd, range-partitioned by subject_id and sorted by (subject_id, event_index)
    <target>/subjects/  parquet: subject_id, n_events
    <target>/header/    json: format version, property names and types
    <target>/dictionary/<property>/  parquet: idx, the value, n; for the properties asked for
    <target>/metadata/  copied from the dataset
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT
from annalist.operators.stats import value_dictionary
from annalist.operators.timeline import subject_counts
from annalist.operators.validate import violations
from annalist.sources import files
from annalist.sources.dataset import FILE, ROW, check_schemas, data_files, normalised, positioned, scan
from annalist.sources.schema import properties_of, spark_schema, type_named
from annalist.sources.sizes import by_range, narrow, scan_tasks

VERSION = 1


class DatasetError(ValueError):
    """Rows of a dataset break a rule."""


def write_header(spark: SparkSession, target: str, properties: dict[str, pa.DataType], mode: str) -> None:
    text = json.dumps({"version": VERSION, "properties": {k: str(v) for k, v in properties.items()}})
    spark.range(1).select(F.lit(text).alias("value")).write.mode(mode).text(f"{target}/header")


def read_header(spark: SparkSession, path: str) -> dict[str, pa.DataType]:
    """Property names and types; raises on another version of the format."""
    if not files.exists(spark, f"{path}/header"):
        raise FileNotFoundError(f"{path} is not a database")
    header = json.loads(spark.read.text(f"{path}/header", wholetext=False).first().value)
    if header["version"] != VERSION:
        raise ValueError(f"{path}: format version {header['version']}, this library reads {VERSION}")
    return {k: type_named(v) for k, v in header["properties"].items()}


def write_tables(events: DataFrame, target: str, mode: str, parts: int | None) -> None:
    """Events are clustered and sorted already, in so many parts. Subjects are counted from what was written, reading
    one column."""
    spark = events.sparkSession
    events.write.mode(mode).option("compression", "zstd").parquet(f"{target}/events")
    counts = subject_counts(spark.read.parquet(f"{target}/events"))
    by_range(counts, narrow(parts), SUBJECT).sortWithinPartitions(SUBJECT).write.mode(mode).option("compression", "zstd").parquet(f"{target}/subjects")


def convert(spark: SparkSession, source: str, target: str, num_threads: int | None = None, strict: bool = True, mode: str = "errorifexists", dictionaries: Sequence[str] = ()) -> None:
    """Writes a dataset as a database.

    Strict mode raises on rows that break a rule, before anything is written; otherwise rows of a subject are joined
    in order of file and row, wherever they stand. Rows without a subject are never accepted. The dictionary of each
    property named is written too, which takes an aggregation of its values. Events are dealt to num_threads tasks or
    more, so that no task sorts more rows as the dataset grows.
    """
    if mode == "errorifexists" and files.exists(spark, target):
        raise FileExistsError(target)
    names = data_files(spark, source)
    declared = check_schemas(spark, names)
    rows = scan(spark, source, spark_schema(declared))
    parts = scan_tasks(spark, rows, f"{source}/data", num_threads)
    if strict:
        found = violations(positioned(rows.select(SUBJECT, "time", FILE, ROW), parts), FILE, ROW)
        faults = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min(SUBJECT).alias("first")).orderBy("rule").collect()
        if faults:
            raise DatasetError("; ".join(f"{r.rule}: {r.n} (first subject {r.first})" for r in faults))
    elif rows.where(F.col(SUBJECT).isNull()).limit(1).count():
        raise DatasetError("null_subject")
    clustered = positioned(normalised(rows), parts).drop(FILE, ROW)
    write_tables(clustered.sortWithinPartitions(SUBJECT, INDEX), target, "overwrite" if mode == "overwrite" else "errorifexists", parts)
    write_header(spark, target, properties_of(declared), "overwrite")
    for name in dictionaries:
        found = value_dictionary(spark.read.parquet(f"{target}/events"), name)
        found.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/dictionary/{name}")
    if files.exists(spark, f"{source}/metadata") and not files.exists(spark, f"{target}/metadata"):
        files.copy_tree(spark, f"{source}/metadata", f"{target}/metadata")
