"""Types and schema rules of event datasets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.columns import INDEX, SUBJECT
from annalist.sources.footers import Declared

MAX_PROPERTIES = 64

#: Property types and the column types that Spark reads them as. Unsigned integers are one size wider.
ARROW_TO_SPARK = {
    pa.string(): T.StringType(),
    pa.large_string(): T.StringType(),
    pa.timestamp("us"): T.TimestampNTZType(),
    pa.float32(): T.FloatType(),
    pa.float64(): T.DoubleType(),
    pa.int8(): T.ByteType(),
    pa.int16(): T.ShortType(),
    pa.int32(): T.IntegerType(),
    pa.int64(): T.LongType(),
    pa.uint8(): T.ShortType(),
    pa.uint16(): T.IntegerType(),
    pa.uint32(): T.LongType(),
    pa.uint64(): T.DecimalType(20, 0),
}
_BY_NAME = {str(a): a for a in ARROW_TO_SPARK}
_NESTED = ("list", "large_list", "fixed_size_list", "struct", "map", "group")


class SchemaError(ValueError):
    """A dataset breaks a schema rule."""


def type_named(name: str) -> pa.DataType:
    return _BY_NAME[name]


def property_names(df: DataFrame) -> list[str]:
    """Properties: all columns but the subject and our own position, sorted bytewise."""
    return sorted((c for c in df.columns if c not in (SUBJECT, INDEX)), key=lambda c: c.encode())


def properties_of(declared: Declared) -> dict[str, pa.DataType]:
    """Sorted property names with the types that the files declare."""
    return {n: type_named(t) for n, t in sorted(declared, key=lambda c: c[0].encode()) if n not in (SUBJECT, INDEX)}


def spark_schema(declared: Declared) -> T.StructType:
    """The columns as Spark reads them, in the order of the file."""
    return T.StructType([T.StructField(n, ARROW_TO_SPARK[type_named(t)]) for n, t in declared])


def schema_faults(declared: Declared) -> list[tuple[str, str, str]]:
    """What is wrong with a schema: (column, rule, in words)."""
    out = []
    by = dict(declared)
    for name, wanted in ((SUBJECT, "int64"), ("time", "timestamp[us]"), ("code", "")):
        if name not in by:
            out.append((name, "missing", f"{name} is missing"))
        elif wanted and by[name] != wanted:
            zone = " without a zone" if "tz=" in by[name] else ""
            out.append((name, "type", f"{name} must be {wanted}{zone}, not {by[name]}"))
    for name, kind in declared:
        if kind.split("<")[0].split("[")[0].split(" ")[0] in _NESTED:
            out.append((name, "not_flat", f"{name} is not flat: {kind}"))
        elif kind not in _BY_NAME and name not in (SUBJECT, "time"):
            out.append((name, "unsupported", f"{name} has an unsupported type: {kind}"))
    if len(by) - 1 > MAX_PROPERTIES:
        out.append(("", "too_many", f"{len(by) - 1} properties are more than {MAX_PROPERTIES}"))
    return out


def schema_difference(first: Declared, other: Declared, ordered: bool = False) -> str:
    """How two files' schemas differ by name and type (and order), or an empty string."""
    if ordered and first != other:
        return f"{first} is not {other}"
    return ", ".join(f"{side} {name}: {kind}" for side, name, kind in declared_differences(first, other))


def declared_differences(first: Declared, other: Declared) -> list[tuple[str, str, str]]:
    """(missing or added, column, type) of what another file declares differently, whatever the order."""
    return [("missing", *c) for c in sorted(set(first) - set(other))] + [("added", *c) for c in sorted(set(other) - set(first))]


def name_difference(ours: set[str], theirs: set[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) names, without the subject."""
    return sorted(ours - theirs - {SUBJECT}), sorted(theirs - ours - {SUBJECT})


def project_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order: unknown ones are dropped, absent ones are null."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        return (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*map(column, schema))
