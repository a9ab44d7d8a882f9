"""Tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="barloom-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/barloom/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` and reads it back, so that what follows does not compute it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of keep() that nothing reads any more."""
    for t in tables:
        for file in t.inputFiles()[:1] if t is not None else ():
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
