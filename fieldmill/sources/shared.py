"""Tables written into the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_dirs: dict[str, str] = {}


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in spark.checkpoint.dir; a local folder only where the session names none and runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = f"file://{tempfile.mkdtemp(prefix='spark-fieldmill-')}"
        at = _local_dirs[app]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no such folder."""
    fs, at = filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: its lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
