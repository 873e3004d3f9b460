"""Checking a database against the dataset it was made from, over all files and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from annalist.functions.columns import INDEX, SUBJECT
from annalist.operators.joins import event_differences
from annalist.operators.stats import sample_subjects
from annalist.sources.convert import read_header
from annalist.sources.dataset import data_files, normalised, positioned, scan
from annalist.sources.footers import distinct_schemas
from annalist.sources.schema import name_difference, schema_faults, spark_schema
from annalist.sources.sizes import scan_tasks


def differences(spark: SparkSession, dataset: str, database: str, schema: StructType, one_in: int = 1) -> DataFrame:
    """(subject_id, event_index, column) where events of a dataset and a database differ, or only one has them (column
    null); of all subjects, or of one in so many."""
    names = sorted(set(schema.fieldNames()) - {SUBJECT, INDEX})
    rows, events = scan(spark, dataset, schema), spark.read.parquet(f"{database}/events")
    given, held = scan_tasks(spark, rows, f"{dataset}/data"), scan_tasks(spark, events, f"{database}/events")
    wanted = positioned(sample_subjects(normalised(rows), one_in), given)
    stored = sample_subjects(events, one_in)
    both = (given or 1) + (held or 1) if given or held else None
    return event_differences(wanted.select(SUBJECT, INDEX, *names), stored.select(SUBJECT, INDEX, *names), both)


def verify_database(spark: SparkSession, dataset: str, database: str, shown: int = 10, one_in: int = 1) -> list[str]:
    """What is wrong with the database: property names, then types, each file's as it declares them, then events; nothing
    if it holds the dataset. one_in: only the events of one in so many subjects, the same ones on every run."""
    stored = {k: str(v) for k, v in read_header(spark, database).items()}
    schemas = distinct_schemas(spark, data_files(spark, dataset))
    for name, declared in schemas:
        missing, extra = name_difference({n for n, _ in declared}, set(stored))
        if missing or extra:
            return [f"{name}: missing properties {missing}, extra properties {extra}"]
        if kinds := [f"{name}: {n} is {t} in the dataset, {stored[n]} in the database" for n, t in declared if n in stored and t != stored[n]]:
            return kinds
    if faults := schema_faults(schemas[0][1]):
        return [message for *_, message in faults]
    found = differences(spark, dataset, database, spark_schema(schemas[0][1]), one_in).limit(shown).collect()
    return [f"subject {r[0]}, event {r[1]}: " + (f"{r[2]} differs" if r[2] else "only one side has it") for r in found]
