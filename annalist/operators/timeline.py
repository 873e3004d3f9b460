"""The event table: rows of subjects with an explicit position, and its lookups, filters and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT

#: Ids of a list that become an IN filter, which reaches the scan; longer lists are joined.
MAX_IN = 1000


def indexed(events: DataFrame, *order: Column) -> DataFrame:
    """Adds event_index, 0-based within a subject, in the given total order."""
    by = Window.partitionBy(SUBJECT).orderBy(*order)
    return events.withColumn(INDEX, (F.row_number().over(by) - 1).cast("bigint"))


def subject_counts(events: DataFrame) -> DataFrame:
    """subject_id, n_events. Partial sums are made before the shuffle."""
    return events.groupBy(SUBJECT).agg(F.count(F.lit(1)).alias("n_events"))


def subject_total(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct(SUBJECT).alias("n_subjects"))


def subject_offsets(events: DataFrame) -> DataFrame:
    """Dense 0-based position of each subject in sorted order.

    Positions come from a range partitioning and the partitions' sizes, not from one window over all subjects.
    """
    return with_positions(events.select(SUBJECT).distinct(), SUBJECT).select(F.col("position").alias("subject_offset"), SUBJECT)


def with_positions(rows: DataFrame, *keys: str | Column, partitions: int | None = None) -> DataFrame:
    """Adds position, the 0-based rank in the order of keys, which must be distinct as a whole.

    Rows are range-partitioned and numbered inside partitions; the partitions' sizes, a handful of numbers that does
    not grow with the rows, give each partition its first number.
    """
    dealt = (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).withColumn("_part", F.spark_partition_id())
    inside = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_begin"))
    return inside.join(F.broadcast(begins), "_part").withColumn("position", (F.col("_begin") + F.col("_rank") - 1).cast("bigint")).drop("_part", "_rank", "_begin")


def lookup(events: DataFrame, subject_id: int) -> DataFrame:
    """One subject's events, in order. The predicate reaches the scan."""
    return events.where(F.col(SUBJECT) == F.lit(subject_id).cast("bigint")).orderBy(INDEX)


def select_subjects(events: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """The events of the given subjects; repeated and unknown ids are harmless."""
    if not isinstance(ids, DataFrame):
        ids = sorted({int(i) for i in ids})
        if len(ids) <= MAX_IN:
            return events.where(F.col(SUBJECT).isin(ids))
        ids = events.sparkSession.createDataFrame([(i,) for i in ids], f"{SUBJECT} bigint")
    return events.join(ids.select(F.col(ids.columns[0]).cast("bigint").alias(SUBJECT)), SUBJECT, "left_semi")


def missing_subjects(ids: DataFrame, events: DataFrame) -> DataFrame:
    """The ids that have no event."""
    return ids.select(SUBJECT).join(events.select(SUBJECT), SUBJECT, "left_anti")


def event_slice(events: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Events start to stop (exclusive) of each subject with Python's rules; negative bounds count from the end."""
    if step == 0:
        raise ValueError("slice step cannot be zero")
    at, n = F.col(INDEX), F.col("_n")

    def clipped(x: int | None, default: Column, low: Column, high: Column) -> Column:
        if x is None:
            return default
        return F.least(F.greatest(n + x if x < 0 else F.lit(x), low), high)

    if step > 0:
        lo, hi = clipped(start, F.lit(0), F.lit(0), n), clipped(stop, n, F.lit(0), n)
        kept = (at >= lo) & (at < hi) & ((at - lo) % step == 0)
    else:
        lo, hi = clipped(start, n - 1, F.lit(-1), n - 1), clipped(stop, F.lit(-1), F.lit(-1), n - 1)
        kept = (at <= lo) & (at > hi) & ((lo - at) % -step == 0)
    if step > 0 and (start is None or start >= 0) and stop is not None and stop >= 0:
        begin = start or 0
        return events.where((at >= begin) & (at < stop) & ((at - begin) % step == 0))
    return events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(SUBJECT))).where(kept).drop("_n")


def event_at(events: DataFrame, position: int) -> DataFrame:
    """The event at a position of each subject that has it; negative positions count from the end."""
    if position >= 0:
        return events.where(F.col(INDEX) == position)
    return events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(SUBJECT))).where(F.col(INDEX) == F.col("_n") + position).drop("_n")


def ends(events: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """The column at each subject's first and last event, in one aggregation."""
    pair = F.struct(INDEX, column)
    return events.groupBy(SUBJECT).agg(F.min(pair)[column].alias(first), F.max(pair)[column].alias(last))
