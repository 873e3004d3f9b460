"""Joins of event tables with tables of rows by subject, and comparisons of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT


def prior_events(rows: DataFrame, events: DataFrame, row_id: str = "row_id", cutoff: str = "cutoff") -> DataFrame:
    """The number of dated events of the subject before each row's cutoff.

    Rows and events are merged in one stream for each subject and counted by a running sum, so the cost is the sum of
    both and not their product. Events at the cutoff are not before it.
    """
    ticks = events.where(F.col("time").isNotNull()).select(SUBJECT, F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), F.col("time").alias("_at"), F.lit(1).alias("_kind"))
    asked = rows.select(SUBJECT, row_id, F.col(cutoff).alias("_at"), F.lit(0).alias("_kind"))
    before = Window.partitionBy(SUBJECT).orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asked.unionByName(ticks).withColumn("n_prior", F.sum(F.col("_kind").cast("bigint")).over(before))
    return counted.where("_kind = 0").select(SUBJECT, row_id, "n_prior")


def difference_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """n_diff: rows, repeated ones counted, that one side has and the other lacks.

    Both sides are counted by value in one aggregation, so neither is shuffled twice.
    """
    columns = left.columns
    tagged = left.withColumn("_side", F.lit(1).cast("bigint")).unionByName(right.select(*columns).withColumn("_side", F.lit(-1).cast("bigint")))
    return tagged.groupBy(*columns).agg(F.sum("_side").alias("_net")).agg(F.coalesce(F.sum(F.abs("_net")), F.lit(0).cast("bigint")).alias("n_diff"))


def event_differences(left: DataFrame, right: DataFrame, partitions: int | None = None) -> DataFrame:
    """(subject_id, event_index, column) for events that only one side has (column null) or that differ in a column;
    null equals null and NaN equals NaN. The sides meet in so many tasks, or in as many as the session shuffles to."""
    if partitions:
        left, right = (side.repartition(partitions, SUBJECT, INDEX) for side in (left, right))
    names = [c for c in left.columns if c not in (SUBJECT, INDEX)]
    a, b = left.alias("a"), right.alias("b")
    key = (F.col(f"a.{SUBJECT}") == F.col(f"b.{SUBJECT}")) & (F.col(f"a.{INDEX}") == F.col(f"b.{INDEX}"))
    both = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), key, "full_outer")
    one_sided = F.col("a._a").isNull() | F.col("b._b").isNull()
    differing = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~F.col(f"a.`{n}`").eqNullSafe(F.col(f"b.`{n}`")), F.lit(n)) for n in names)))
    found = F.when(one_sided, F.array(F.lit(None).cast("string"))).otherwise(differing)
    return both.select(F.coalesce(f"a.{SUBJECT}", f"b.{SUBJECT}").alias(SUBJECT), F.coalesce(f"a.{INDEX}", f"b.{INDEX}").alias(INDEX), F.explode(found).alias("column"))


def keep_subjects_with(events: DataFrame, least: int) -> DataFrame:
    """The events of subjects that have `least` events or more."""
    return events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(SUBJECT))).where(F.col("_n") >= least).drop("_n")
