"""Work tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications that have no shared one set.
_temporary: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Where that is unset, a temporary folder will do in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _temporary:
            _temporary[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="marquee-")
        base = _temporary[spark.sparkContext.applicationId]
    return f"{base.rstrip('/')}/marquee-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """A new folder of this application in the shared folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all work tables of this application; call it when the results are written."""
    remove(spark, _root(spark))


def saved(df: DataFrame) -> DataFrame:
    """Writes df and reads it back: its lineage ends there."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished tables <path>/<number>, ascending."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1]))


def remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)
