"""Queries that go through files: datasets, databases, views, rewriting, subsets, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT, hash_part, next_power_of_two
from annalist.operators import stats, validate
from annalist.operators import timeline as ops
from annalist.plans import roundtrip
from annalist.plans.registry import query
from annalist.plans.timeline import raw_events, table
from annalist.sources import files
from annalist.sources.footers import distinct_schemas
from annalist.sources.schema import declared_differences, schema_faults

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_KINDS = "CASE {} WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp[us]' WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' ELSE {} END"
_RICH = "SELECT c_custkey AS subject_id FROM customer WHERE c_acctbal > 9000"


@query("SELECT subject_id, event_index, time, code, numeric_value, priority, CAST(src_id AS BIGINT) AS src_id FROM ev")
def convert_and_read(spark, d):
    return roundtrip.timeline_database(spark, d).events.select(SUBJECT, INDEX, "time", "code", "numeric_value", "priority", "src_id")


@query("SELECT subject_id, count(*) AS n_events FROM ev GROUP BY subject_id")
def convert_and_count(spark, d):
    return roundtrip.timeline_database(spark, d).subjects


@query("SELECT subject_id, count(*) AS n_events, max(CASE WHEN event_index = n - 1 THEN code END) AS last_code FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ev) t GROUP BY subject_id")
def map_subjects(spark, d):
    rows = lambda s: [{SUBJECT: s.subject_id, "n_events": len(s.events), "last_code": s.events[-1].code}]
    return roundtrip.timeline_database(spark, d).map_to_df(rows, "subject_id bigint, n_events bigint, last_code string", properties=["code"])


@query("SELECT CAST(part AS BIGINT) AS part, count(*) AS n_subjects, min(subject_id) AS lo, max(subject_id) AS hi, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT subject_id, n, ntile(4) OVER (ORDER BY subject_id) AS part FROM (SELECT subject_id, count(*) AS n FROM ev GROUP BY subject_id) s) t GROUP BY part")
def map_function(spark, d):
    return roundtrip.mapped_parts(spark, d)


@query("SELECT count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_prior FROM (SELECT d.row_id, count(ev.event_index) AS n FROM (SELECT o_custkey AS subject_id, o_orderkey AS row_id, o_orderdate AS cutoff FROM orders WHERE o_orderpriority LIKE '1%') d LEFT JOIN ev ON ev.subject_id = d.subject_id AND ev.time < d.cutoff GROUP BY d.row_id) t")
def map_with_data_function(spark, d):
    return roundtrip.mapped_pairs(spark, d)


@query("SELECT subject_id * 10 AS subject_id, event_index, code FROM ev")
def transform_and_convert(spark, d):
    return roundtrip.scaled_database(spark, d).events.select(SUBJECT, INDEX, "code")


@query("SELECT subject_id, event_index, code FROM ev WHERE subject_id IN (1, 32, 64)")
def subset_and_read(spark, d):
    return roundtrip.cut_database(spark, d, [64, 1, 32]).events.select(SUBJECT, INDEX, "code")


@query(f"SELECT property, {_KINDS.format('kind', 'kind')} AS type FROM (SELECT unnest(['code', 'numeric_value', 'priority', 'src_id', 'time']) AS property, unnest([typeof(code), typeof(numeric_value), typeof(priority), typeof(src_id), typeof(time)]) AS kind FROM (SELECT * FROM ev LIMIT 1) one) t")
def database_properties(spark, d):
    found = roundtrip.timeline_database(spark, d).properties
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "property string, type string")


_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {t})" for t in TABLES)


@query(
    f"""WITH c AS ({_COLUMNS})
SELECT DISTINCT table_name, need AS "column", 'missing' AS rule FROM c, (SELECT unnest(['subject_id', 'time', 'code']) AS need) n WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.table_name = c.table_name AND o.column_name = need)
UNION ALL SELECT table_name, column_name, 'not_flat' FROM c WHERE column_type LIKE '%[]'""",
    prelude=False,
)
def schema_report(spark, d):
    """What each table lacks to be an event dataset, from its footers."""
    rows = [(t, column, rule) for t in TABLES for column, rule, _ in schema_faults(distinct_schemas(spark, files.parquet_files(spark, f"{d}/{t}.parquet"))[0][1])]
    return spark.createDataFrame(rows, "table_name string, column string, rule string")


@query(
    f"""WITH a AS (SELECT column_name, {_KINDS.format('column_type', 'column_type')} AS type FROM (DESCRIBE documents)), b AS (SELECT column_name, {_KINDS.format('column_type', 'column_type')} AS type FROM (DESCRIBE labels))
SELECT 'missing' AS side, column_name AS "column", type FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT 'added', column_name, type FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y""",
    prelude=False,
)
def schema_differences(spark, d):
    first, other = (distinct_schemas(spark, files.parquet_files(spark, f"{d}/{t}.parquet"))[0][1] for t in ("documents", "labels"))
    return spark.createDataFrame(declared_differences(first, other), "side string, column string, type string")


_BROKEN = "SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS subject_id, CASE event_type WHEN 'error' THEN NULL ELSE ts + INTERVAL 5 DAY * (event_id % 3) END AS time, event_id FROM events"


@query(
    f"""WITH r AS ({_BROKEN}), p AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY event_id) - 1 AS event_index FROM r),
 l AS (SELECT *, lag(time) OVER (PARTITION BY subject_id ORDER BY event_index) AS prev FROM p)
SELECT CASE WHEN subject_id IS NULL THEN 'null_subject' WHEN time IS NULL THEN 'null_time_after_time' ELSE 'time_decreases' END AS rule, subject_id, CAST(event_index AS BIGINT) AS event_index FROM l WHERE subject_id IS NULL OR (prev IS NOT NULL AND time IS NULL) OR time < prev
UNION ALL SELECT 'scattered_subject', subject_id, NULL FROM r WHERE subject_id IS NOT NULL GROUP BY subject_id HAVING max(event_id) - min(event_id) + 1 <> count(*)""",
    prelude=False,
)
def rule_violations(spark, d):
    """The user events with gaps: ids, times and places made to break every rule."""
    moved = F.when(F.col("event_type") != "error", F.col("ts") + F.make_dt_interval(F.col("event_id") % 3 * 5))
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 97 != 0, F.col("user_id")).alias(SUBJECT), moved.alias("time"), F.lit("one").alias("_file"), F.col("event_id").alias("_row"))
    return validate.violations(ops.indexed(rows, F.col("_row")), "_file", "_row")


@query(f"SELECT CAST(row_number() OVER (ORDER BY subject_id) - 1 AS BIGINT) AS position, subject_id, (SELECT count(*) FROM ({_RICH}) a) AS n FROM ({_RICH}) s")
def view_iter(spark, d):
    """A view's ids in order and its length."""
    view = roundtrip.timeline_database(spark, d).filter(_rich(spark, d))
    n = len(view)
    return spark.createDataFrame([(i, s, n) for i, s in enumerate(view)], "position bigint, subject_id bigint, n bigint")


def _rich(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")


@query(f"SELECT subject_id, event_index, code FROM ev WHERE subject_id IN ({_RICH})")
def view_events(spark, d):
    return roundtrip.timeline_database(spark, d).filter(_rich(spark, d)).events.select(SUBJECT, INDEX, "code")


@query(f"SELECT subject_id, event_index, code FROM ev WHERE subject_id IN ({_RICH}) AND subject_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def view_of_view(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey").distinct()
    return roundtrip.timeline_database(spark, d).filter(_rich(spark, d)).filter(dear).events.select(SUBJECT, INDEX, "code")


@query("SELECT w.id AS subject_id, count(*) AS n_events FROM (SELECT unnest([1, 32, 32, 64])::BIGINT AS id, unnest([0, 1, 2, 3]) AS visit) w JOIN ev ON ev.subject_id = w.id GROUP BY w.id, w.visit")
def view_map(spark, d):
    """A function on a view, which visits a subject as often as its id was given."""
    view = roundtrip.timeline_database(spark, d).filter([64, 32, 1, 32])
    parts = view.map(lambda subjects: [(s.subject_id, len(s.events)) for s in subjects], properties=["code"])
    return spark.createDataFrame([pair for part in parts for pair in part], "subject_id bigint, n_events bigint")


@query("SELECT subject_id, event_index, code FROM ev WHERE subject_id % 7 = 3")
def subset_from_id_file(spark, d):
    return roundtrip.cut_by_file(spark, d, 7, 3).events.select(SUBJECT, INDEX, "code")


@query("SELECT place, '{\"tables\": [\"customer\", \"orders\"], \"n_customers\": ' || (SELECT count(*) FROM customer) || '}' AS content FROM (SELECT unnest(['database', 'rewritten', 'subset']) AS place) p", prelude=False)
def metadata_copies(spark, d):
    """The metadata file as converting, rewriting and cutting leave it."""
    made = {"database": roundtrip.timeline_database(spark, d), "rewritten": roundtrip.scaled_database(spark, d), "subset": roundtrip.cut_database(spark, d, [64, 1, 32])}
    rows = None
    for place, database in made.items():
        own = spark.read.text(f"{database.path_to_database}/metadata/dataset.json").select(F.lit(place).alias("place"), F.col("value").alias("content"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query(
    """SELECT subject_id, 'Subject(subject_id=' || subject_id || ', len(events)=' || count(*) || ')' AS subject, 'Events(subject_id=' || subject_id || ', len(events)=' || count(*) || ')' AS events,
 max(CASE event_index WHEN 0 THEN 'Event(time=None, code=' || code || ', ...)' END) AS first_event, max(CASE event_index WHEN 1 THEN 'Event(time=' || strftime(time, '%Y-%m-%d %H:%M:%S') || ', code=' || code || ', ...)' END) AS second_event FROM ev GROUP BY subject_id"""
)
def subject_strings(spark, d):
    def written(s):
        return [{SUBJECT: s.subject_id, "subject": str(s), "events": str(s.events), "first_event": str(s.events[0]), "second_event": str(s.events[1]) if len(s.events) > 1 else None}]

    return roundtrip.timeline_database(spark, d).map_to_df(written, "subject_id bigint, subject string, events string, first_event string, second_event string", properties=["time", "code"])


@query("SELECT o_custkey AS subject_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS event_index, o_orderdate - INTERVAL 40000 DAY AS time, o_orderdate - INTERVAL 50000 DAY - INTERVAL 1 MICROSECOND AS entered FROM orders", prelude=False)
def ancient_times(spark, d):
    """Times before 1970 with fractions of a second, in two columns, through a database."""
    return roundtrip.ancient_database(spark, d).events.select(SUBJECT, INDEX, "time", "entered")


@query("SELECT subject_id, CAST(('0x' || substr(md5(CAST(subject_id AS VARCHAR)), 1, 8))::BIGINT % 16 AS INTEGER) AS part FROM (SELECT DISTINCT subject_id FROM ev) s")
def hash_parts(spark, d):
    return raw_events(spark, d).select(SUBJECT).distinct().select(SUBJECT, hash_part(F.col(SUBJECT), 16).alias("part"))


@query("SELECT subject_id, event_index, CASE WHEN numeric_value < 0 THEN 'negative' ELSE code END AS code, CASE WHEN event_index > 0 THEN priority END AS priority, CASE WHEN numeric_value >= 1000 THEN numeric_value END AS numeric_value FROM ev")
def transform_mutable(spark, d):
    """A rewrite that sets, reads and deletes properties, known and unknown ones."""

    def changed(subject):
        for event in subject.events:
            if event.numeric_value < 0:
                event.code = "negative"
            if event.nothing is None and event.numeric_value < 1000:
                del event.numeric_value
            event.unknown = dict(list(event))
        return subject

    return roundtrip.rewritten_rows(spark, d, "mutable", changed).select(SUBJECT, INDEX, "code", "priority", "numeric_value")


_DIFFERENT = """SELECT subject_id, event_index, 'numeric_value' AS "column" FROM ev WHERE src_id % 5 = 0 AND subject_id % 11 <> 0 UNION ALL SELECT subject_id, event_index, NULL FROM ev WHERE subject_id % 11 = 0"""


@query(_DIFFERENT)
def verify_report(spark, d):
    """A dataset with other values for some orders and without some subjects, against the database."""
    return roundtrip.differing_events(spark, d)


@query(f"SELECT * FROM ({_DIFFERENT}) t WHERE ('0x' || substr(md5(CAST(subject_id AS VARCHAR)), 1, 8))::BIGINT % 3 = 0")
def verify_sample(spark, d):
    """The same for one in three subjects."""
    return roundtrip.differing_events(spark, d, 3)


@query("SELECT unnest(['Event', 'Subject', 'SubjectDatabase']) AS name, TRUE AS found", prelude=False)
def public_names(spark, d):
    """Names that the package exports."""
    import annalist

    return spark.createDataFrame([(n, n in annalist.__all__ and hasattr(annalist, n)) for n in ("Event", "Subject", "SubjectDatabase")], "name string, found boolean")


@query("SELECT count(DISTINCT subject_id) AS n_subjects, TRUE AS closed FROM ev")
def database_lifecycle(spark, d):
    """A database counts inside its block and refuses to map after it."""
    with roundtrip.timeline_database(spark, d) as database:
        n = len(database)
    try:
        database.map(list)
        closed = False
    except RuntimeError:
        closed = True
    return spark.createDataFrame([(n, closed)], "n_subjects bigint, closed boolean")


@query("SELECT unnest(['code', 'numeric_value', 'priority', 'src_id', 'time']) AS property, unnest([coalesce(sum(strlen(code)), 0), 8 * count(numeric_value), coalesce(sum(strlen(priority)), 0), 8 * count(src_id), 8 * count(time)])::BIGINT AS bytes FROM ev")
def size_estimate(spark, d):
    return stats.size_estimate(raw_events(spark, d))


@query("SELECT subject_id, count(*) AS n_events, CAST(CASE WHEN count(*) <= 1 THEN 1 ELSE 1 << length(bin(count(*) - 1)) END AS BIGINT) AS slots FROM ev GROUP BY subject_id")
def table_slots(spark, d):
    """Slots of a hash table for each subject's events: the next power of two."""
    return ops.subject_counts(raw_events(spark, d)).withColumn("slots", next_power_of_two(F.col("n_events")))


@query("SELECT CAST(row_number() OVER (ORDER BY n DESC, code DESC) - 1 AS BIGINT) AS idx, code, n FROM (SELECT code, count(*) AS n, count(DISTINCT subject_id) AS u FROM ev WHERE code IS NOT NULL AND code <> '' GROUP BY code) d WHERE u > 1")
def stored_dictionary(spark, d):
    return roundtrip.timeline_database(spark, d).dictionary("code")
