"""Statistics of event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.columns import INDEX, MICROS_PER_DAY, SUBJECT, hash_part, micros_between, whole
from annalist.operators.timeline import with_positions
from annalist.sources.schema import property_names

RUN_CHUNK = 15
#: Bytes of a value, where they are not 8.
WIDTHS = {"byte": 1, "short": 2, "integer": 4, "float": 4}


def value_counts(events: DataFrame, name: str) -> DataFrame:
    """Each value of a property with n (occurrences) and n_subjects.

    Counts are first summed by value and subject, so a value that most events have is spread over its subjects, and
    the second sum has one row for each of those.
    """
    present = events.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    by_subject = present.groupBy(name, SUBJECT).agg(F.count(F.lit(1)).alias("n"))
    return by_subject.groupBy(name).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_subjects"))


def value_dictionary(events: DataFrame, name: str) -> DataFrame:
    """idx, value and n of the values that more than one subject has, the most frequent first, ties by value descending."""
    shared = value_counts(events, name).where("n_subjects > 1").select(name, "n", (-F.col("n")).alias("_least"))
    return with_positions(shared, "_least", F.col(name).desc()).select(F.col("position").alias("idx"), name, "n")


def encoded(events: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """The events with idx, the dictionary's number of the property's value, null for values it doesn't have."""
    return events.join(dictionary.select(name, "idx"), name, "left")


def presence_mask(events: DataFrame, names: Sequence[str] | None = None, alias: str = "null_map") -> DataFrame:
    """subject_id, event_index and a bit mask: bit i is set where the i-th property in name order is not null."""
    mask = F.lit(0).cast("bigint")
    for i, name in enumerate(sorted(names, key=str.encode) if names else property_names(events)):
        mask = mask.bitwiseOR(F.when(F.col(name).isNotNull(), F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return events.select(SUBJECT, INDEX, mask.alias(alias))


def mask_bits(mask: Column) -> Column:
    """The numbers of a mask's set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)


def presence_counts(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: n_events and, for each property, n_<name>."""
    return events.agg(F.count(F.lit(1)).alias("n_events"), *(F.count(n).alias(f"n_{n}") for n in names))


def present_properties(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row (subject_id, event_index, property) for each non-null property, from one scan."""
    filled = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in sorted(names, key=str.encode))))
    return events.select(SUBJECT, INDEX, F.explode(filled).alias("property"))


def leading_nulls(events: DataFrame) -> DataFrame:
    """subject_id and num_null, its static events: those without a time stand first."""
    return events.groupBy(SUBJECT).agg(F.count_if(F.col("time").isNull()).alias("num_null"))


def timestamp_runs(events: DataFrame, chunk: int = RUN_CHUNK) -> DataFrame:
    """Events of a subject at one time: n, and n_chunks of `chunk` events at most."""
    runs = events.where(F.col("time").isNotNull()).groupBy(SUBJECT, "time").agg(F.count(F.lit(1)).alias("n"))
    return runs.withColumn("n_chunks", whole(F.col("n") + (chunk - 1), chunk))


def time_deltas(events: DataFrame) -> DataFrame:
    """The time since the subject's event before, as days, seconds and microseconds."""
    before = F.lag("time").over(Window.partitionBy(SUBJECT).orderBy(INDEX))
    gaps = events.select(SUBJECT, INDEX, micros_between(before, F.col("time")).alias("us")).where("us IS NOT NULL")
    return gaps.select(
        SUBJECT,
        INDEX,
        whole(F.col("us"), MICROS_PER_DAY).alias("delta_days"),
        whole(F.col("us") % MICROS_PER_DAY, 1_000_000).alias("delta_seconds"),
        (F.col("us") % 1_000_000).alias("delta_micros"),
    )


def restored_times(deltas: DataFrame, starts: DataFrame) -> DataFrame:
    """Times from each subject's first time and the deltas after it: the inverse of time_deltas."""
    us = F.col("delta_days") * MICROS_PER_DAY + F.col("delta_seconds") * 1_000_000 + F.col("delta_micros")
    total = F.sum(us).over(Window.partitionBy(SUBJECT).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0))
    return deltas.withColumn("_us", total).join(starts, SUBJECT).select(SUBJECT, INDEX, F.timestamp_add("MICROSECOND", F.col("_us"), F.col("start")).alias("time"))


def sample_subjects(events: DataFrame, one_in: int) -> DataFrame:
    """All events of about one in so many subjects, the same ones on every run."""
    return events if one_in == 1 else events.where(hash_part(F.col(SUBJECT), one_in) == 0)


def size_estimate(events: DataFrame) -> DataFrame:
    """property and bytes: what the non-null values of each property take before they are encoded, from one aggregation."""
    names = property_names(events)

    def size(name: str) -> Column:
        kind = events.schema[name].dataType
        width = F.octet_length(name) if isinstance(kind, T.StringType) else F.when(F.col(name).isNotNull(), F.lit(WIDTHS.get(kind.typeName(), 8)))
        return F.coalesce(F.sum(width.cast("bigint")), F.lit(0).cast("bigint"))

    return events.agg(*(size(n).alias(n) for n in names)).unpivot([], names, "property", "bytes")
