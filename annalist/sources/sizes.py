"""How many tasks rows are dealt to.

A sort or a window holds a task's rows, so their number must not grow with the table. The session's number of shuffle
partitions is fixed, and adaptive execution joins partitions by their compressed bytes, of which events have few (a file's
name repeats in every row); so tasks are counted from the rows, which footers tell, and the stored bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources import files

ROWS_A_TASK = 200_000
#: Bytes of zstd parquet, which are several times as many in memory.
BYTES_A_TASK = 16 << 20


def tasks(n_rows: int, n_bytes: int = 0, least: int | None = None) -> int | None:
    """The number of tasks, `least` or more; None leaves rows that one task can take to adaptive execution."""
    needed = max(-(-n_rows // ROWS_A_TASK), -(-n_bytes // BYTES_A_TASK))
    return max(least, needed) if least else needed if needed > 1 else None


def narrow(parts: int | None) -> int | None:
    """Tasks for rows of an id and a count that are made of events dealt to so many: an eighth."""
    return -(-parts // 8) if parts and parts > 8 else None


def scan_tasks(spark: SparkSession, rows: DataFrame, folder: str, least: int | None = None) -> int | None:
    """Tasks for all rows of the parquet files in a folder."""
    return tasks(rows.select().count(), files.total_bytes(spark, folder), least)


def database_tasks(spark: SparkSession, path: str, subjects: DataFrame, more: int = 0) -> int | None:
    """Tasks for the events of some of a database's subjects, told by their counts, and for more rows."""
    n = (subjects.agg(F.sum("n_events")).first()[0] or 0) + more
    share = n / max(1, spark.read.parquet(f"{path}/events").count())
    return tasks(n, int(files.total_bytes(spark, f"{path}/events") * share))


def by_range(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)


def by_hash(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
