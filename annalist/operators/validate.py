"""Rules that rows of an event table keep, and the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT


def time_order_violations(events: DataFrame, *order: str | Column, keep: tuple[str, ...] = (INDEX,)) -> DataFrame:
    """Rows whose time is before the one ahead of them in the subject, or null after a time."""
    by = Window.partitionBy(SUBJECT).orderBy(*(order or (INDEX,)))
    with_lag = events.select(SUBJECT, *keep, "time", F.lag("time").over(by).alias("_prev"))
    return with_lag.where(F.col("_prev").isNotNull() & (F.col("time").isNull() | (F.col("time") < F.col("_prev")))).select(SUBJECT, *keep)


def subject_segments(rows: DataFrame, subject: str, place: str) -> DataFrame:
    """subject_id and n_segments: the runs of adjacent rows that a subject has, if places are consecutive integers.

    A row starts a run if no row of the subject stands at the place before it, so this needs a window for each
    subject and never one over all rows.
    """
    by = Window.partitionBy(subject).orderBy(place)
    starts = rows.select(subject, (F.coalesce(F.col(place) - F.lag(place).over(by) > 1, F.lit(True))).alias("_start"))
    return starts.groupBy(F.col(subject).alias(SUBJECT)).agg(F.sum(F.col("_start").cast("bigint")).alias("n_segments"))


def scattered_subjects(rows: DataFrame, file: str, row: str) -> DataFrame:
    """Subjects whose rows are not adjacent rows of one file."""
    spans = rows.groupBy(SUBJECT).agg(F.min(file).alias("_f"), F.max(file).alias("_g"), F.min(row).alias("_a"), F.max(row).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return spans.where((F.col("_f") != F.col("_g")) | (F.col("_b") - F.col("_a") + 1 != F.col("_n"))).select(SUBJECT)


def violations(rows: DataFrame, file: str, row: str) -> DataFrame:
    """(rule, subject_id, event_index) for each row, or subject (event_index null), that breaks a rule.

    event_index has to be on the rows already; only the columns used here are read.
    """
    none = F.lit(None).cast("bigint")
    by = Window.partitionBy(SUBJECT).orderBy(INDEX)
    timed = rows.select(SUBJECT, INDEX, "time", F.lag("time").over(by).alias("_prev"))
    rule = (
        F.when(F.col(SUBJECT).isNull(), "null_subject")
        .when(F.col("_prev").isNotNull() & F.col("time").isNull(), "null_time_after_time")
        .when(F.col("time") < F.col("_prev"), "time_decreases")
    )
    broken = timed.select(rule.alias("rule"), SUBJECT, INDEX).where(F.col("rule").isNotNull())
    apart = scattered_subjects(rows.where(F.col(SUBJECT).isNotNull()), file, row)
    return broken.unionByName(apart.select(F.lit("scattered_subject").alias("rule"), SUBJECT, none.alias(INDEX)))
