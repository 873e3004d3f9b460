"""Footers by both ways, file and id sources, work folders."""

import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from annalist import SubjectDatabase, convert, verify_database
from annalist.plans import roundtrip
from annalist.sources import footers
from annalist.sources.schema import SchemaError, schema_difference, schema_faults
from annalist.sources.subset import as_ids

KINDS = [pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64(), pa.float32(), pa.float64(), pa.string(), pa.timestamp("us"), pa.timestamp("ms"), pa.timestamp("us", "UTC"), pa.bool_(), pa.date32(), pa.binary()]


def base(*more):
    return pa.schema([("subject_id", pa.int64()), ("time", pa.timestamp("us")), ("code", pa.string()), *more])


def write(path, schema, rows=(), **options):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.Table.from_pylist(list(rows), schema=schema), path, **options)
    return str(path)


def test_both_ways_find_the_declared_types(spark, tmp_path):
    plain = write(tmp_path / "a.parquet", pa.schema([(f"c{i}", t) for i, t in enumerate(KINDS)]), store_schema=False)
    rich = write(tmp_path / "b.parquet", pa.schema([("s", pa.large_string()), ("d", pa.dictionary(pa.int32(), pa.string())), ("l", pa.list_(pa.int8())), ("u", pa.uint8())]))
    spark.sql("SELECT 1Y AS b, TIMESTAMP_NTZ '1960-01-01 00:00:00' AS t, 'x' AS s").write.parquet(str(tmp_path / "spark"))
    own = str(next((tmp_path / "spark").glob("*.parquet")))
    for name in (plain, rich, own):
        theirs, ours = footers._by_hadoop(spark, name), footers._by_arrow(name)
        assert [(n, t.split("<")[0]) for n, t in theirs] == [(n, t.split("<")[0]) for n, t in ours]
    assert footers._by_arrow(plain) == [(f"c{i}", str(t)) for i, t in enumerate(KINDS)]
    assert footers._by_arrow(rich)[:2] == [("s", "large_string"), ("d", "string")]


@pytest.mark.parametrize("opens", [True, False])
def test_schemas_do_not_depend_on_the_store(spark, tmp_path, monkeypatch, opens):
    monkeypatch.setattr(footers, "_arrow_opens", lambda spark, name: opens)
    row = {"subject_id": 1, "code": "a", "n": 3}
    write(tmp_path / "in/data/0.parquet", base(("n", pa.uint8())), [row])
    convert(spark, str(tmp_path / "in"), str(tmp_path / "db"))
    assert SubjectDatabase(str(tmp_path / "db"), spark=spark).properties["n"] == pa.uint8()
    assert verify_database(spark, str(tmp_path / "in"), str(tmp_path / "db")) == []
    write(tmp_path / "in/data/1.parquet", base(("n", pa.int16())), [row | {"subject_id": 2}])
    assert "n is int16 in the dataset, uint8 in the database" in verify_database(spark, str(tmp_path / "in"), str(tmp_path / "db"))[0]
    with pytest.raises(SchemaError, match="int16"):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "other"))


def test_a_store_that_arrow_does_not_open(spark):
    assert not footers._arrow_opens(spark, "nosuchstore://somewhere/x.parquet")


def test_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(footers, "FILES_A_TASK", 3)
    for i in range(20):
        write(tmp_path / f"in/data/{i:02}.parquet", base(), [{"subject_id": i, "code": "a"}])
    write(tmp_path / "in/data/07.parquet", base(("x", pa.int8())), [{"subject_id": 7, "code": "a"}])
    found = footers.distinct_schemas(spark, sorted(map(str, (tmp_path / "in/data").glob("*.parquet"))))
    assert [(name[-10:], len(declared)) for name, declared in found] == [("00.parquet", 3), ("07.parquet", 4)]


def test_faults_and_differences():
    faults = schema_faults([("subject_id", "int32"), ("code", "string"), ("tags", "list<item: string>"), ("day", "date32[day]"), ("g", "group")])
    assert [f[:2] for f in faults] == [("subject_id", "type"), ("time", "missing"), ("tags", "not_flat"), ("day", "unsupported"), ("g", "not_flat")]
    assert [f[:2] for f in schema_faults([("subject_id", "int64"), ("time", "timestamp[ms]"), ("code", "string")])] == [("time", "type")]
    a, b = [("x", "int8"), ("y", "string")], [("y", "string"), ("x", "int8")]
    assert not schema_difference(a, b) and schema_difference(a, b, ordered=True) and "uint8" in schema_difference(a, [("x", "uint8"), ("y", "string")])


def test_id_file_is_cut_to_tasks(spark, tmp_path):
    ids = [3 * i - 10**6 for i in range(200_000)]
    (tmp_path / "ids").write_bytes(struct.pack(f"<{len(ids)}q", *ids))
    assert sorted(r[0] for r in as_ids(spark, str(tmp_path / "ids")).collect()) == ids


def test_work_folder_is_shared(spark, monkeypatch):
    folder = roundtrip.work_folder(spark)
    assert folder.startswith(str(roundtrip.work_folder(spark)).rsplit("/", 1)[0])

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        roundtrip.work_folder(Session())


def test_metadata_is_json(spark, sf):
    path = roundtrip.timeline_database(spark, sf).path_to_database
    assert json.loads(spark.read.text(f"{path}/metadata/dataset.json").first().value)["tables"] == ["customer", "orders"]
