"""What the files of a dataset declare: column names and types, from parquet footers.

Footers are read by tasks, so a dataset of very many files takes no loop on the driver, which gets the distinct schemas.
Stores that pyarrow cannot open, but Spark can, are read through Hadoop by threads of the driver. Both ways give the
types that the writer declared, unsigned and large ones too, wherever the files lie.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from annalist.sources import files

#: Column names and types, in the order of the file; types by the names that Arrow gives them.
Declared = list[tuple[str, str]]
#: Different schemas that are reported; one that differs from the first is an error already.
MAX_SCHEMAS = 100
FILES_A_TASK = 64

# Types of plain parquet columns by physical type and annotation, where no Arrow schema is stored.
_PLAIN = {
    ("BOOLEAN", ""): "bool",
    ("INT32", ""): "int32",
    ("INT64", ""): "int64",
    ("INT96", ""): "timestamp[ns]",
    ("FLOAT", ""): "float",
    ("DOUBLE", ""): "double",
    ("BINARY", ""): "binary",
    ("BINARY", "STRING"): "string",
    ("INT32", "DATE"): "date32[day]",
}
_PLAIN |= {("INT64" if bits == 64 else "INT32", f"INTEGER({bits},{signed})"): f"{'' if signed == 'true' else 'u'}int{bits}" for bits in (8, 16, 32, 64) for signed in ("true", "false")}
_PLAIN |= {("INT64", f"TIMESTAMP({unit},{utc})"): f"timestamp[{name}{', tz=UTC' if utc == 'true' else ''}]" for unit, name in (("MILLIS", "ms"), ("MICROS", "us"), ("NANOS", "ns")) for utc in ("true", "false")}
_DICTIONARY = re.compile(r"dictionary<values=([^,]+),.*>")


def _declared(schema: pa.Schema) -> Declared:
    """A dictionary column counts as one of its values."""
    return [(f.name, _DICTIONARY.sub(r"\1", str(f.type))) for f in schema]


def _by_arrow(name: str) -> Declared:
    local = files.local_path(name)
    if local:
        return _declared(pq.read_schema(local))
    store, path = pyarrow.fs.FileSystem.from_uri(name)
    return _declared(pq.read_schema(path, filesystem=store))


def _by_hadoop(spark: SparkSession, name: str) -> Declared:
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        meta = reader.getFooter().getFileMetaData()
        stored = meta.getKeyValueMetaData().get("ARROW:schema")
        if stored:
            return _declared(pa.ipc.read_schema(pa.py_buffer(base64.b64decode(stored))))
        out = []
        for field in meta.getSchema().getFields():
            annotation = field.getLogicalTypeAnnotation()
            note = annotation.toString() if annotation else ""
            kind = field.asPrimitiveType().getPrimitiveTypeName().toString() if field.isPrimitive() else "group"
            out.append((field.getName(), _PLAIN.get((kind, note), f"{kind} {note}".strip())))
        return out
    finally:
        reader.close()


def _arrow_opens(spark: SparkSession, name: str) -> bool:
    """Whether tasks can open the store, found with one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            try:
                found = bool(_by_arrow(name))
            except Exception:  # any failure of an unknown store means the other way
                found = False
            yield pa.RecordBatch.from_arrays([pa.array([found])], names=["found"])

    return files.local_path(name) is not None or spark.range(1, numPartitions=1).mapInArrow(run, "found boolean").first().found


def distinct_schemas(spark: SparkSession, names: list[str]) -> list[tuple[str, Declared]]:
    """Each schema that files declare with the first of its files, in order of these; the first MAX_SCHEMAS."""
    if not _arrow_opens(spark, names[0]):
        first: dict[str, str] = {}
        with ThreadPoolExecutor(16) as pool:
            for name, found in zip(names, pool.map(lambda n: json.dumps(_by_hadoop(spark, n)), names), strict=True):
                first.setdefault(found, name)
        return [(name, [tuple(c) for c in json.loads(found)]) for found, name in list(first.items())[:MAX_SCHEMAS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [json.dumps(_by_arrow(n)) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read, pa.string())], names=["file", "declared"])

    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(-(-len(names) // FILES_A_TASK))
    rows = listed.mapInArrow(run, "file string, declared string").groupBy("declared").agg(F.min("file").alias("file")).orderBy("file").limit(MAX_SCHEMAS).collect()
    return [(r.file, [tuple(c) for c in json.loads(r.declared)]) for r in rows]
