"""Tables in the folder that driver and executors share: scratch tables, and indexes that are published once for an input."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one on a local master, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table, by Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return ";".join(sorted(found))


_PUBLISHED: dict[tuple[str, str, str], DataFrame] = {}


def published(spark: SparkSession, label: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows, written once for the session and the state of the files of the input tables; other callers read that table. Inputs that
    have changed are built from anew."""
    key = (f"{spark.sparkContext.applicationId}:{spark.sparkContext.startTime}", label, "|".join(_state(spark, path) for path in inputs))
    if key not in _PUBLISHED:
        _PUBLISHED[key] = written(build(), label)
    return _PUBLISHED[key]
