"""Files beside the tables, through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder as it is."""
    (a, from_fs), (b, to_fs) = _path(spark, source), _path(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, b, False, spark._jsc.hadoopConfiguration())


def total_bytes(spark: SparkSession, folder: str) -> int:
    """The size of all files below a folder."""
    path, fs = _path(spark, folder)
    return fs.getContentSummary(path).getLength()


def write_bytes(spark: SparkSession, name: str, data: bytes) -> None:
    """A small new file."""
    path, fs = _path(spark, name)
    out = fs.create(path, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def parquet_files(spark: SparkSession, folder: str) -> list[str]:
    """All .parquet files below a folder, sorted."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    out, found = [], fs.listFiles(path, True)
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".parquet"):
            out.append(name)
    return sorted(out)


def local_path(name: str) -> str | None:
    """The plain path of a file on this machine, or None for a file elsewhere."""
    if name.startswith("file:"):
        return "/" + name[5:].lstrip("/")
    return name if "://" not in name else None
