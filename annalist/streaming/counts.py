"""Event tables that grow: running statistics over new files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Rows of the files that appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind in tumbling windows; a window is final when the watermark has passed its end, which bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), kind).agg(F.count(F.lit(1)).alias("n"))


def subject_counts(stream: DataFrame, subject: str) -> DataFrame:
    """Running number of events of each subject."""
    return stream.groupBy(F.col(subject).alias("subject_id")).agg(F.count(F.lit(1)).alias("n_events"))


def run_to_end(counts: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a query over what is there now and gives the result table. For tests and reports: it is held by the driver."""
    name = f"stream_{uuid.uuid4().hex}"
    query = counts.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)
