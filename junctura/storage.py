"""Intermediate tables in the cluster's shared folder (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Of intermediate tables; arrays of junctions' ids take three fifths of what they take as snappy.
CODEC = "zstd"


@cache
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="junctura-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on this machine, one temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or _temporary()).rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; clean() deletes what was put there."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: what follows starts from files that survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this process has written to the shared folder; results that still read them can't be read again."""
    conf = spark._jsc.hadoopConfiguration()
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(conf).delete(at, True)
