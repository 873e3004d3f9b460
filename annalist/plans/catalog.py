"""Queries over the driver tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT, empty_to_null
from annalist.operators import joins, stats, validate
from annalist.operators import timeline as ops
from annalist.operators.groups import grouped, records
from annalist.plans.registry import ORACLES, QUERIES, query
from annalist.plans.timeline import raw_events, table, timeline
from annalist.sources.schema import project_to
from annalist.streaming import counts as streams
from annalist.subject import rows_from_subject, subject_from_rows

PROPERTIES = ["code", "numeric_value", "priority", "time"]


@query("SELECT count(DISTINCT subject_id) AS n_subjects FROM ev")
def subject_count(spark, d):
    return ops.subject_total(raw_events(spark, d))


@query("SELECT subject_id, count(*) AS n_events FROM ev GROUP BY subject_id")
def subject_index(spark, d):
    return ops.subject_counts(raw_events(spark, d))


@query("SELECT CAST(row_number() OVER (ORDER BY subject_id) - 1 AS BIGINT) AS subject_offset, subject_id FROM (SELECT DISTINCT subject_id FROM ev) s")
def subject_iter(spark, d):
    return ops.subject_offsets(raw_events(spark, d))


@query("SELECT event_index, time, code, numeric_value, priority FROM ev WHERE subject_id = 32")
def subject_lookup(spark, d):
    return ops.lookup(timeline(spark, d), 32).select(INDEX, "time", "code", "numeric_value", "priority")


@query("SELECT subject_id, event_index, code FROM ev WHERE subject_id IN (1, 32, 64)")
def subject_filter(spark, d):
    return ops.select_subjects(timeline(spark, d), [64, 1, 32, 32]).select(SUBJECT, INDEX, "code")


@query("SELECT subject_id, event_index, code FROM ev WHERE subject_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def subject_semi_join(spark, d):
    chosen = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey")
    return ops.select_subjects(timeline(spark, d), chosen).select(SUBJECT, INDEX, "code")


@query("SELECT CAST(w.id AS BIGINT) AS subject_id FROM (SELECT 32 AS id UNION ALL SELECT 34234) w LEFT JOIN ev ON ev.subject_id = w.id WHERE ev.subject_id IS NULL")
def subject_filter_missing(spark, d):
    wanted = spark.range(1).select(F.explode(F.array(F.lit(32), F.lit(34234)).cast("array<bigint>")).alias(SUBJECT))
    return ops.missing_subjects(wanted, raw_events(spark, d))


@query("SELECT subject_id, max(CASE WHEN event_index = 0 THEN code END) AS first_code, max(CASE WHEN event_index = n - 1 THEN code END) AS last_code FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ev) t GROUP BY subject_id")
def event_first_last(spark, d):
    return ops.ends(timeline(spark, d), "code", "first_code", "last_code")


@query("SELECT subject_id, event_index, code FROM ev WHERE event_index >= 1 AND event_index < 3")
def event_slice(spark, d):
    return ops.event_slice(timeline(spark, d), 1, 3).select(SUBJECT, INDEX, "code")


@query("SELECT subject_id, event_index, code FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ev) t WHERE event_index >= greatest(n - 5, 0) AND event_index < n - 1 AND (event_index - greatest(n - 5, 0)) % 2 = 0")
def event_slice_from_end(spark, d):
    return ops.event_slice(timeline(spark, d), -5, -1, 2).select(SUBJECT, INDEX, "code")


@query("SELECT subject_id, event_index, code FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ev) t WHERE event_index = n - 2")
def event_at_negative(spark, d):
    return ops.event_at(timeline(spark, d), -2).select(SUBJECT, INDEX, "code")


@query("SELECT subject_id, event_index, 'code' AS property FROM ev WHERE code IS NOT NULL UNION ALL SELECT subject_id, event_index, 'numeric_value' FROM ev WHERE numeric_value IS NOT NULL UNION ALL SELECT subject_id, event_index, 'priority' FROM ev WHERE priority IS NOT NULL UNION ALL SELECT subject_id, event_index, 'time' FROM ev WHERE time IS NOT NULL")
def event_properties(spark, d):
    return stats.present_properties(timeline(spark, d), PROPERTIES)


@query("SELECT subject_id, event_index, CAST((CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN numeric_value IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN priority IS NOT NULL THEN 4 ELSE 0 END) + (CASE WHEN time IS NOT NULL THEN 8 ELSE 0 END) AS BIGINT) AS null_map FROM ev")
def presence_bitmask(spark, d):
    return stats.presence_mask(timeline(spark, d), PROPERTIES)


@query("SELECT subject_id, event_index, CAST(CASE WHEN time IS NULL THEN 2 ELSE 4 END AS BIGINT) AS n_present FROM ev")
def presence_bits(spark, d):
    return stats.presence_mask(timeline(spark, d), PROPERTIES).select(SUBJECT, INDEX, F.size(stats.mask_bits(F.col("null_map"))).cast("bigint").alias("n_present"))


@query("SELECT count(*) AS n_events, count(code) AS n_code, count(numeric_value) AS n_numeric_value, count(priority) AS n_priority, count(time) AS n_time FROM ev")
def presence_counts(spark, d):
    return stats.presence_counts(raw_events(spark, d), PROPERTIES)


@query("SELECT code, count(*) AS n, count(DISTINCT subject_id) AS n_subjects FROM ev WHERE code IS NOT NULL AND code <> '' GROUP BY code")
def value_statistics(spark, d):
    return stats.value_counts(raw_events(spark, d), "code")


_DICTIONARY = "SELECT CAST(row_number() OVER (ORDER BY n DESC, code DESC) - 1 AS BIGINT) AS idx, code, n FROM (SELECT code, count(*) AS n, count(DISTINCT subject_id) AS u FROM ev WHERE code IS NOT NULL AND code <> '' GROUP BY code) d WHERE u > 1"


@query(_DICTIONARY)
def value_dictionary(spark, d):
    return stats.value_dictionary(raw_events(spark, d), "code")


@query(f"SELECT subject_id, event_index, idx FROM ev LEFT JOIN ({_DICTIONARY}) v USING (code)")
def dictionary_encoding(spark, d):
    events = timeline(spark, d)
    return stats.encoded(events, stats.value_dictionary(raw_events(spark, d), "code"), "code").select(SUBJECT, INDEX, "idx")


@query("SELECT subject_id, src_id FROM (SELECT subject_id, src_id, time, lag(time) OVER (PARTITION BY subject_id ORDER BY src_id NULLS FIRST) AS prev FROM ev) t WHERE prev IS NOT NULL AND (time IS NULL OR time < prev)")
def time_order_violations(spark, d):
    return validate.time_order_violations(raw_events(spark, d), F.col("src_id").asc_nulls_first(), keep=("src_id",))


@query("SELECT subject_id, src_id FROM (SELECT subject_id, src_id, time, lag(time) OVER (PARTITION BY subject_id ORDER BY src_id DESC NULLS FIRST) AS prev FROM ev) t WHERE prev IS NOT NULL AND (time IS NULL OR time < prev)")
def time_order_violations_reversed(spark, d):
    return validate.time_order_violations(raw_events(spark, d), F.col("src_id").desc_nulls_first(), keep=("src_id",))


@query("SELECT subject_id, time, count(*) AS n, CAST((count(*) + 14) // 15 AS BIGINT) AS n_chunks FROM ev WHERE time IS NOT NULL GROUP BY subject_id, time")
def timestamp_runs(spark, d):
    return stats.timestamp_runs(raw_events(spark, d))


@query("SELECT subject_id, CAST(sum(CASE WHEN time IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_null FROM ev GROUP BY subject_id")
def static_events(spark, d):
    return stats.leading_nulls(raw_events(spark, d))


_GAPS = "SELECT *, date_diff('microsecond', lag(time) OVER (PARTITION BY subject_id ORDER BY event_index), time) AS us FROM ev"


@query(f"SELECT subject_id, event_index, us // 86400000000 AS delta_days, (us % 86400000000) // 1000000 AS delta_seconds, us % 1000000 AS delta_micros FROM ({_GAPS}) t WHERE us IS NOT NULL")
def time_delta_parts(spark, d):
    return stats.time_deltas(timeline(spark, d))


@query("SELECT subject_id, event_index, time FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY event_index) AS k FROM ev WHERE time IS NOT NULL) t WHERE k > 1")
def time_from_deltas(spark, d):
    events = timeline(spark, d)
    return stats.restored_times(stats.time_deltas(events), events.groupBy(SUBJECT).agg(F.min("time").alias("start")))


@query("SELECT CAST(part AS BIGINT) AS part, count(*) AS n_subjects, min(subject_id) AS lo, max(subject_id) AS hi FROM (SELECT subject_id, ntile(4) OVER (ORDER BY subject_id) AS part FROM (SELECT DISTINCT subject_id FROM ev) s) t GROUP BY part")
def map_partitions(spark, d):
    """A function called once for each of four even parts of the subjects, over a stream of their rows."""
    n = 4
    subjects = raw_events(spark, d).select(SUBJECT).distinct()
    at = ops.with_positions(subjects, SUBJECT)
    total = at.agg(F.count(F.lit(1)).alias("total"))
    placed = at.crossJoin(F.broadcast(total))  # one row
    q, r = F.call_function("div", F.col("total"), F.lit(n).cast("bigint")), F.col("total") % n
    part = F.when(F.col("position") < r * (q + 1), F.floor(F.col("position") / (q + 1))).otherwise(r + F.floor((F.col("position") - r * (q + 1)) / F.greatest(q, F.lit(1))))
    dealt = placed.select(SUBJECT, part.cast("int").alias("part")).repartitionById(n, F.col("part")).sortWithinPartitions(SUBJECT)

    def run(batches):
        part, count, lo, hi = None, 0, None, None
        for row in records(batches):
            part, count, lo, hi = row["part"] + 1, count + 1, row[SUBJECT] if lo is None else lo, row[SUBJECT]
        rows = [] if part is None else [{"part": part, "n_subjects": count, "lo": lo, "hi": hi}]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("part", "n_subjects", "lo", "hi")]))

    return dealt.mapInArrow(run, "part bigint, n_subjects bigint, lo bigint, hi bigint")


@query("SELECT d.subject_id, d.row_id, count(ev.event_index) AS n_prior FROM (SELECT o_custkey AS subject_id, o_orderkey AS row_id, o_orderdate AS cutoff FROM orders WHERE o_orderpriority LIKE '1%') d LEFT JOIN ev ON ev.subject_id = d.subject_id AND ev.time < d.cutoff GROUP BY d.subject_id, d.row_id")
def map_with_data(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias(SUBJECT), F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("cutoff"))
    return joins.prior_events(rows, raw_events(spark, d))


def _transformed(events: DataFrame, change: Callable) -> DataFrame:
    """A function of whole subjects applied to a stream of rows sorted by subject."""
    from pyspark.sql.pandas.types import to_arrow_schema

    clustered = events.repartition(SUBJECT).sortWithinPartitions(SUBJECT, INDEX)
    schema, names = clustered.schema, clustered.columns
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = []
        for (subject_id,), own in grouped(records(batches), SUBJECT):
            changed = change(subject_from_rows(subject_id, list(own)))
            held += rows_from_subject(changed, names) if changed is not None else []
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return clustered.mapInArrow(run, schema)


@query("SELECT subject_id * 10 AS subject_id, event_index, code FROM ev")
def transform_scale_id(spark, d):
    def scaled(subject):
        subject.subject_id *= 10
        return subject

    return _transformed(timeline(spark, d).select(SUBJECT, INDEX, "code"), scaled)


@query("SELECT subject_id, event_index, code FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ev) t WHERE n >= 12")
def transform_drop(spark, d):
    return joins.keep_subjects_with(timeline(spark, d).select(SUBJECT, INDEX, "code"), 12)


@query("SELECT subject_id, event_index, code FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ev) t WHERE n >= 12")
def transform_drop_function(spark, d):
    return _transformed(timeline(spark, d).select(SUBJECT, INDEX, "code"), lambda s: s if len(s.events) >= 12 else None)


@query("SELECT subject_id, event_index, upper(code) AS code, CASE WHEN FALSE THEN priority END AS priority FROM ev")
def transform_schema(spark, d):
    events = timeline(spark, d)
    wanted = events.select(SUBJECT, INDEX, "code", "priority").schema
    return project_to(events.drop("priority").withColumn("code", F.upper("code")).withColumn("unknown", F.lit(1)), wanted)


@query("SELECT event_id, nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '') AS code FROM events", prelude=False)
def empty_to_null_values(spark, d):
    events = table(spark, d, "events")
    return events.select("event_id", empty_to_null(F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))).alias("code"))


@query("SELECT user_id AS subject_id, count(*) AS n_segments FROM (SELECT user_id, event_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events) t WHERE p IS NULL OR p <> user_id GROUP BY user_id", prelude=False)
def subject_segments(spark, d):
    return validate.subject_segments(table(spark, d, "events"), "user_id", "event_id").withColumn("n_segments", F.col("n_segments").cast("bigint"))


@query("SELECT CAST((SELECT count(*) FROM (SELECT subject_id, time, code FROM raw EXCEPT ALL SELECT subject_id, time, code FROM ev) a) + (SELECT count(*) FROM (SELECT subject_id, time, code FROM ev EXCEPT ALL SELECT subject_id, time, code FROM raw) b) AS BIGINT) AS n_diff")
def verify_diff(spark, d):
    columns = [SUBJECT, "time", "code"]
    return joins.difference_count(raw_events(spark, d).select(*columns), timeline(spark, d).select(*columns))


@query("SELECT a.subject_id, a.event_index, 'code' AS \"column\" FROM ev a WHERE a.numeric_value < 0")
def verify_positions(spark, d):
    events = timeline(spark, d).select(SUBJECT, INDEX, "time", "code", "numeric_value")
    changed = events.withColumn("code", F.when(F.col("numeric_value") < 0, "changed").otherwise(F.col("code")))
    return joins.event_differences(events, changed)


@query("SELECT conv_id AS subject_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS event_index, role AS code FROM conversations", prelude=False)
def conversation_events(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias(SUBJECT), "turn", F.col("role").alias("code"))
    return ops.indexed(turns, F.col("turn")).select(SUBJECT, INDEX, "code")


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1", prelude=False)
def nullable_property(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where(F.col("quality").isNull() | (F.col("quality") == 1)).select("doc_id", "quality", "toxic")


@query("SELECT user_id AS subject_id, count(*) AS n_events FROM events GROUP BY user_id", prelude=False)
def stream_subject_counts(spark, d):
    batch = table(spark, d, "events")
    stream = streams.event_stream(spark, d, batch.schema, "events.parquet")
    return streams.run_to_end(streams.subject_counts(stream, "user_id"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", prelude=False)
def stream_windowed_counts(spark, d):
    batch = table(spark, d, "events")
    stream = streams.event_stream(spark, d, batch.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    done = streams.run_to_end(streams.windowed_counts(stream, "ts", "event_type", "1 day"))
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT subject_id, event_index, code FROM ev WHERE ('0x' || substr(md5(CAST(subject_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 0")
def subject_sample(spark, d):
    """All events of about a tenth of the subjects, by a hash of the id."""
    return stats.sample_subjects(timeline(spark, d), 10).select(SUBJECT, INDEX, "code")


from annalist.plans import database_queries  # noqa: E402, F401  registers the queries that go through files

__all__ = ["ORACLES", "QUERIES"]
