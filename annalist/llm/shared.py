"""Cutting lineage in the folder that driver and executors share, joins with hot keys, names that do not clash."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if more than one row in so many has it.
HOT = 1000


def _shared_folder(context: SparkContext) -> str:
    """The cluster's spark.checkpoint.dir. Only where none is set (a session on one machine, as in tests) a local
    temporary folder is made, which goes when Python ends."""
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="annalist-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which outlives lost executors."""
    _shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def released(*checkpoints: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing reads any more, not even a plan that has not run. Shuffles of plans
    that are gone are deleted when the driver collects its garbage, which may be long after, so it is asked to."""
    for df in checkpoints:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            removed(df.sparkSession, file.get())
    gc.collect()
    checkpoints[0].sparkSession._jvm.System.gc()


def written(df: DataFrame) -> str:
    """Writes the rows as a Parquet table under the shared folder and gives its folder."""
    folder = f"{_shared_folder(df.sparkSession.sparkContext)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, such as a table that `written` made and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def names_aside(columns: list[str], added: Iterable[str]) -> dict[str, str]:
    """New names, taken by no column, for the columns that are called like one added."""
    out: dict[str, str] = {}
    for name in added:
        if name in columns:
            other = f"_{name}"
            while other in columns or other in added or other in out.values():
                other = f"_{other}"
            out[name] = other
    return out


def join_values(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the values of their keys, which are distinct in `values`; count: how many rows have the key.

    Keys that more than one row in HOT has are fewer than HOT, so they are broadcast, and no task gets all rows of one."""
    total, most = values.agg(F.sum(count), F.max(count)).first()
    plain = values.drop(count)
    if not total or most * HOT <= total:
        return rows.join(plain, keys)
    is_hot = F.col(count) * HOT > total
    hot = F.broadcast(values.where(is_hot).drop(count))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(values.where(~is_hot).drop(count), keys))
