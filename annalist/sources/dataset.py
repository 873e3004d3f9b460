"""Reading event datasets: a folder with data/**/*.parquet and, beside it, metadata/."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.columns import INDEX, SUBJECT, empty_to_null
from annalist.sources import files
from annalist.sources.footers import Declared, distinct_schemas
from annalist.sources.schema import SchemaError, schema_difference, schema_faults, spark_schema
from annalist.sources.sizes import by_range, scan_tasks

FILE, ROW = "_file", "_row"


def data_files(spark: SparkSession, path: str) -> list[str]:
    found = files.parquet_files(spark, f"{path}/data")
    if not found:
        raise FileNotFoundError(f"no parquet files below {path}/data")
    return found


def check_schemas(spark: SparkSession, names: list[str], ordered: bool = False) -> Declared:
    """The schema that all files declare; raises if a file's differs or breaks a rule."""
    (first, declared), *others = distinct_schemas(spark, names)
    for name, other in others:
        if difference := schema_difference(declared, other, ordered):
            raise SchemaError(f"{name}: schema is not that of {first}: {difference}")
    if faults := schema_faults(declared):
        raise SchemaError("; ".join(message for *_, message in faults))
    return declared


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of all files, with the file and the row's place in it."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    rows = (reader.schema(schema) if schema is not None else reader).parquet(f"{path}/data")
    return rows.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def positioned(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows clustered by subject with event_index, the place in order of file and row.

    The window uses the range partitioning as it is, so the rows are shuffled once.
    """
    by = Window.partitionBy(SUBJECT).orderBy(FILE, ROW)
    return by_range(rows, partitions, SUBJECT).withColumn(INDEX, (F.row_number().over(by) - 1).cast("bigint"))


def normalised(rows: DataFrame) -> DataFrame:
    """Empty strings become nulls."""
    text = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType) and f.name != FILE]
    return rows.withColumns({c: empty_to_null(F.col(f"`{c}`")) for c in text}) if text else rows


def read_dataset(spark: SparkSession, path: str, strict: bool = True, partitions: int | None = None) -> DataFrame:
    """The events of a dataset with event_index, in `partitions` or more; strict checks every file's schema first."""
    schema = spark_schema(check_schemas(spark, data_files(spark, path))) if strict else None
    rows = scan(spark, path, schema)
    return positioned(normalised(rows), scan_tasks(spark, rows, f"{path}/data", partitions)).drop(FILE, ROW)
