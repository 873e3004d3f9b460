"""The rows that a task sorts don't grow with the dataset: more rows are more tasks, with the same results."""

import pytest
from test_database import events, write_dataset

from annalist import SubjectDatabase, convert, transform_dataset, write_subset
from annalist.plans import roundtrip
from annalist.sources import sizes
from annalist.sources.dataset import check_schemas, data_files, read_dataset
from annalist.sources.schema import spark_schema
from annalist.verify import differences

N = 400
ROWS = [{"subject_id": i, "code": c} for i in range(N) for c in ("a", f"b{i}")]


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(sizes, "ROWS_A_TASK", 100)


@pytest.fixture
def source(tmp_path):
    return write_dataset(tmp_path / "in", events(*ROWS[:300]), events(*ROWS[300:]))


@pytest.fixture
def db(source, tmp_path, spark, few):
    convert(spark, source, str(tmp_path / "db"))
    return SubjectDatabase(str(tmp_path / "db"), 3, spark)


def n_files(folder):
    return len(list(folder.glob("*.parquet")))


def test_tasks():
    assert sizes.tasks(sizes.ROWS_A_TASK) is None and sizes.tasks(sizes.ROWS_A_TASK + 1) == 2
    assert sizes.tasks(5, 3 * sizes.BYTES_A_TASK) == 3 and sizes.tasks(5, 5, 4) == 4 and sizes.tasks(9 * sizes.ROWS_A_TASK, 5, 4) == 9


def test_conversion(db, spark, tmp_path):
    assert n_files(tmp_path / "db/events") >= 7
    rows = db.map_to_df(lambda s: [{"id": s.subject_id, "last": s.events[-1].code}], "id bigint, last string", properties=["code"])
    assert rows.rdd.getNumPartitions() == 8 and sorted(map(tuple, rows.collect())) == [(i, f"b{i}") for i in range(N)]
    write_subset(spark, db.path_to_database, str(tmp_path / "half"), list(range(0, N, 2)))
    assert n_files(tmp_path / "half/events") >= 3 and list(SubjectDatabase(str(tmp_path / "half"), spark=spark)) == list(range(0, N, 2))


def test_dataset_of_rows(spark, tmp_path, few):
    rows = spark.createDataFrame([(i,) for i in range(N)], "subject_id bigint").selectExpr("subject_id", "CAST(NULL AS timestamp_ntz) AS time", "'a' AS code", "subject_id AS src_id")
    roundtrip.write_rows(rows, str(tmp_path / "rows"), {})
    assert n_files(tmp_path / "rows/data") >= 3 and read_dataset(spark, str(tmp_path / "rows")).count() == N


def test_rewriting(source, spark, tmp_path, few):
    transform_dataset(source, str(tmp_path / "out"), lambda s: s, 2, spark)
    assert n_files(tmp_path / "out/data") >= 5
    found = read_dataset(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() >= 7 and sorted((r.subject_id, r.code) for r in found.collect()) == sorted((r["subject_id"], r["code"]) for r in ROWS)


def test_differences(db, source, spark):
    schema = spark_schema(check_schemas(spark, data_files(spark, source)))
    found = differences(spark, source, db.path_to_database, schema)
    assert found.rdd.getNumPartitions() == 16 and found.count() == 0


def test_maps(db, spark):
    """Parts are put together from ranges that more tasks sort, in order."""
    ids = [x for part in db.map(lambda subjects: [(s.subject_id, [e.code for e in s.events]) for s in subjects]) for x in part]
    assert db._tasks() == 8 and ids == [(i, ["a", f"b{i}"]) for i in range(N)]
    assert [len(part) for part in db.filter([9, 9, *range(50, 160)]).map(list)] == [38, 37, 37]
    side = spark.createDataFrame([(i, k) for k in range(2) for i in range(0, N, 4)], "subject_id bigint, mark int")
    pairs = [x for part in db.map_with_data(lambda it: [(s.subject_id, len(s.events), [r.mark for r in rows]) for s, rows in it], side) for x in part]
    assert pairs == [(i, 2, [0, 1]) for i in range(0, N, 4)]
