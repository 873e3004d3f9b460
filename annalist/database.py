"""A database of subjects: a mapping from ids to subjects over DataFrames."""

from __future__ import annotations

import collections
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, TypeVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.columns import INDEX, SUBJECT
from annalist.operators.groups import CHUNKS, chunks, grouped, ordered, records
from annalist.operators.stats import value_dictionary
from annalist.operators.timeline import lookup, missing_subjects, with_positions
from annalist.sources import files
from annalist.sources.convert import read_header
from annalist.sources.sizes import by_hash, database_tasks, narrow
from annalist.subject import Event, Subject

A = TypeVar("A")
_TIME = "time"


def _event(row: dict[str, Any], names: Sequence[str]) -> Event:
    return Event({n: row[n] for n in names})


class SubjectDatabase:
    """Reads a converted database.

    `num_threads` is the number of partitions that `map` and `map_with_data` call their function on. `events` and
    `subjects` are DataFrames for everything that can be said declaratively.
    """

    def __init__(self, path_to_database: str, num_threads: int = 1, spark: SparkSession | None = None):
        if num_threads < 1:
            raise ValueError("num_threads must be 1 or more")
        self.path_to_database = str(path_to_database)
        self.num_threads = num_threads
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._properties = read_header(self.spark, self.path_to_database)
        self._ids: DataFrame | None = None
        self._closed = False

    @property
    def properties(self) -> dict[str, pa.DataType]:
        """Property names, sorted, with their types; subject_id is none of them."""
        return dict(self._properties)

    @property
    def all_events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path_to_database}/events")

    @property
    def events(self) -> DataFrame:
        """The events of the selected subjects, each once."""
        every = self.all_events
        return every if self._ids is None else every.join(self._ids.select(SUBJECT), SUBJECT, "left_semi")

    @property
    def subjects(self) -> DataFrame:
        """subject_id and n_events of the selected subjects, each once."""
        every = self.spark.read.parquet(f"{self.path_to_database}/subjects")
        return every if self._ids is None else every.join(self._ids.select(SUBJECT), SUBJECT, "left_semi")

    def dictionary(self, name: str) -> DataFrame:
        """idx, value and n of the property's values that more than one subject of the database has: stored, or made now."""
        if name not in self._properties:
            raise AttributeError(f"no property {name!r}")
        stored = f"{self.path_to_database}/dictionary/{name}"
        return self.spark.read.parquet(stored) if files.exists(self.spark, stored) else value_dictionary(self.all_events, name)

    def __len__(self) -> int:
        """The number of subjects; of a view, of the ids it was made with."""
        return (self.subjects if self._ids is None else self._ids).count()

    def __iter__(self) -> Iterator[int]:
        """Ids in ascending order, partition by partition."""
        ids = (self.subjects if self._ids is None else self._ids).select(SUBJECT)
        return (r[0] for r in ids.orderBy(SUBJECT).toLocalIterator())

    def __contains__(self, subject_id: int) -> bool:
        return (self.subjects if self._ids is None else self._ids).where(F.col(SUBJECT) == int(subject_id)).limit(1).count() > 0

    def __getitem__(self, subject_id: int) -> Subject:
        """One subject. A view finds every subject of its database."""
        subject_id = int(subject_id)
        rows = list(records(lookup(self.all_events, subject_id).toArrow().to_batches()))
        if not rows:
            raise KeyError(subject_id)
        return Subject(subject_id, [_event(r, tuple(self._properties)) for r in rows])

    def filter(self, subject_ids: Iterable[int] | DataFrame) -> SubjectDatabase:
        """A view of the given subjects. Ids are neither made distinct nor looked up; a view of a view has what both have."""
        if isinstance(subject_ids, DataFrame):
            ids = subject_ids.select(F.col(subject_ids.columns[0]).cast("bigint").alias(SUBJECT))
        else:
            ids = self.spark.createDataFrame([(i,) for i in sorted(map(int, subject_ids))], f"{SUBJECT} bigint")
        out = SubjectDatabase.__new__(SubjectDatabase)
        out.__dict__.update(self.__dict__)
        out._ids = ids if self._ids is None else ids.join(self._ids, SUBJECT, "left_semi")
        return out

    def _names(self, properties: Sequence[str] | None) -> tuple[str, ...]:
        if properties is None:
            return tuple(self._properties)
        if unknown := set(properties) - set(self._properties):
            raise AttributeError(f"no properties {sorted(unknown)}")
        return tuple(sorted(properties, key=str.encode))

    def _check_open(self) -> None:
        if self._closed:
            raise RuntimeError("the database is closed")

    def _visits(self) -> DataFrame:
        """subject_id and visit: each id of the view as often as it was given."""
        if self._ids is None:
            return self.subjects.select(SUBJECT, F.lit(1).alias("visits"))
        return self._ids.groupBy(SUBJECT).agg(F.count(F.lit(1)).cast("int").alias("visits"))

    def _dealt(self, ids: DataFrame, tasks: int | None) -> DataFrame:
        """ids with part: consecutive ids in num_threads parts whose sizes differ by one at most."""
        n = self.num_threads
        if n == 1:
            return ids.withColumn("part", F.lit(0))
        size, rest = divmod(ids.count(), n)
        at = with_positions(ids, SUBJECT, partitions=narrow(tasks))
        long = rest * (size + 1)
        part = F.when(F.col("position") < long, F.floor(F.col("position") / (size + 1))).otherwise(rest + F.floor((F.col("position") - long) / max(size, 1)))
        return at.withColumn("part", part.cast("int")).drop("position")

    def _tasks(self, more: int = 0) -> int | None:
        return database_tasks(self.spark, self.path_to_database, self.subjects, more)

    def _require(self, ids: DataFrame) -> None:
        if missing := [r[0] for r in missing_subjects(ids, self.spark.read.parquet(f"{self.path_to_database}/subjects")).orderBy(SUBJECT).limit(1).collect()]:
            raise KeyError(missing[0])

    def map(self, map_func: Callable[[Iterator[Subject]], A], properties: Sequence[str] | None = None) -> Iterator[A]:
        """Calls the function once a partition, on its subjects in ascending order, and gives the results in the order
        of the partitions. Only the columns in `properties` are read, if given: a function hides which it uses."""
        self._check_open()
        names = self._names(properties)
        visits = self._visits()
        if self._ids is not None:
            self._require(visits)
        tasks = self._tasks()
        events = by_hash(self.all_events.select(SUBJECT, INDEX, *names), tasks, SUBJECT).join(by_hash(self._dealt(visits, tasks), tasks, SUBJECT), SUBJECT)
        if self._ids is not None:
            events = events.withColumn("visit", F.explode(F.sequence(F.lit(1), "visits")))
        else:
            events = events.withColumn("visit", F.lit(1))
        return self._results(events.drop("visits"), tasks, (SUBJECT, "visit", INDEX), lambda rows: (Subject(k[0], [_event(r, names) for r in own]) for k, own in grouped(rows, SUBJECT, "visit")), map_func)

    def map_with_data(self, map_func: Callable[[Iterator[tuple[Subject, list]]], A], data: Any, assume_sorted: bool = False, properties: Sequence[str] | None = None) -> Iterator[A]:
        """Like map, on the subjects that `data` has rows of, each with its rows as named tuples in their order.

        `data` is a pandas or Spark DataFrame with a subject_id column; every id has to be in the database. Rows need
        not be sorted, so `assume_sorted` changes nothing.
        """
        self._check_open()
        names = self._names(properties)
        table = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data.reset_index(drop=True)) if len(data) else self.spark.createDataFrame([], ", ".join(f"`{c}` bigint" for c in data.columns))
        columns = table.columns
        packed = table.select(F.col(SUBJECT).cast("bigint").alias(SUBJECT), F.monotonically_increasing_id().alias(INDEX), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("data"))
        if self._ids is not None:
            packed = packed.join(self._ids.select(SUBJECT), SUBJECT, "left_semi")
        ids = packed.select(SUBJECT).distinct()
        self._require(ids)
        tasks = self._tasks(packed.count())
        parts = by_hash(self._dealt(ids, tasks), tasks, SUBJECT)
        events = by_hash(self.all_events.select(SUBJECT, INDEX, *names), tasks, SUBJECT).join(parts, SUBJECT).withColumn("kind", F.lit(1))
        both = by_hash(packed, tasks, SUBJECT).join(parts, SUBJECT).withColumn("kind", F.lit(0)).unionByName(events, allowMissingColumns=True)

        def pairs(rows):
            row_type = collections.namedtuple("Pandas", columns, rename=True)
            for (subject_id,), own in grouped(rows, SUBJECT):
                extra, found = [], []
                for r in own:
                    if r["kind"] == 0:
                        extra.append(row_type(*(r["data"][c] for c in columns)))
                    else:
                        found.append(_event(r, names))
                yield Subject(subject_id, found), extra

        return self._results(both, tasks, (SUBJECT, "kind", INDEX), pairs, map_func)

    def _results(self, rows: DataFrame, tasks: int | None, order: Sequence[str], items: Callable[[Iterator[dict]], Iterator[Any]], func: Callable[[Iterator[Any]], A]) -> Iterator[A]:
        """What the function returns for each part, empty ones included; one pickled cell a part.

        A part is a num_threads-th of the rows, too many for one task's sort. So as many tasks as the rows ask for sort
        ranges of them and pack these to chunks; a part's task has only the chunks' places to sort.
        """
        pieces = max(self.num_threads, tasks or 1)
        packed = rows.repartitionByRange(pieces, "part", SUBJECT).sortWithinPartitions("part", *order).mapInArrow(chunks, CHUNKS)

        def run(batches):
            result = func(items(records(ordered(batches))))
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(result)], pa.binary())], names=["result"])

        found = packed.repartitionById(self.num_threads, F.col("part")).mapInArrow(run, "result binary").toLocalIterator(prefetchPartitions=True)
        return (cloudpickle.loads(bytes(r.result)) for r in found)

    def map_to_df(self, map_func: Callable[[Subject], Iterable[dict[str, Any]]], schema: str, properties: Sequence[str] | None = None) -> DataFrame:
        """A DataFrame of the rows that the function gives for each subject, one by one."""
        self._check_open()
        names = self._names(properties)
        clustered = by_hash(self.events.select(SUBJECT, INDEX, *names), self._tasks(), SUBJECT).sortWithinPartitions(SUBJECT, INDEX)
        arrow = _arrow_schema(self.spark, schema)

        def run(batches):
            held = []
            for (subject_id,), own in grouped(records(batches), SUBJECT):
                held += map_func(Subject(subject_id, [_event(r, names) for r in own]))
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

        return clustered.mapInArrow(run, schema)

    def terminate(self) -> None:
        """Closes the database for further maps. The session stays, as others may use it."""
        self._closed = True

    def __enter__(self) -> SubjectDatabase:
        return self

    def __exit__(self, *_: Any) -> None:
        self.terminate()

    def __str__(self) -> str:
        return f"SubjectDatabase(path={self.path_to_database})"

    def __reduce__(self):
        raise TypeError("a database cannot be sent to executors; send its path")


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)
