"""Rewriting a dataset subject by subject."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from annalist.functions.columns import SUBJECT
from annalist.operators.groups import grouped, records
from annalist.sources import files
from annalist.sources.dataset import FILE, ROW, check_schemas, data_files, scan
from annalist.sources.schema import spark_schema
from annalist.sources.sizes import by_hash, scan_tasks
from annalist.subject import MutableSubject, rows_from_subject, subject_from_rows

_ROWS = 4096


def transform_dataset(source: str, target: str, transform_func: Callable[[MutableSubject], MutableSubject | None], num_threads: int | None = None, spark: SparkSession | None = None) -> None:
    """Writes the dataset that a function makes of each subject, or none of it where it returns None.

    The source's schema is kept: properties it doesn't have are dropped, those an event lacks are null. Files' schemas
    have to be equal, order included. Subjects are dealt to num_threads tasks, or to as many as the session shuffles to;
    to more if these would have to sort too many rows each.
    Events are written in the order the function leaves them in; a later conversion
    checks them.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    if files.exists(spark, target):
        raise FileExistsError(target)
    schema = spark_schema(check_schemas(spark, data_files(spark, source), ordered=True))
    names, arrow = schema.fieldNames(), to_arrow_schema(schema)
    rows = scan(spark, source, schema)
    rows = by_hash(rows, scan_tasks(spark, rows, f"{source}/data", num_threads), SUBJECT).sortWithinPartitions(SUBJECT, FILE, ROW).drop(FILE, ROW)

    def run(batches):
        held = []
        for (subject_id,), own in grouped(records(batches), SUBJECT):
            changed = transform_func(subject_from_rows(subject_id, list(own)))
            if changed is not None:
                held += rows_from_subject(changed, names)
            if len(held) >= _ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{target}/data")
    if files.exists(spark, f"{source}/metadata"):
        files.copy_tree(spark, f"{source}/metadata", f"{target}/metadata")
