"""Folders and tables that driver and executors share."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


_made: set[str] = set()
#: Spark's setting by which an execution's shuffle files go when it ends. Else they stay until the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """A folder of this application's own in spark.checkpoint.dir, or in the warehouse where that is unset, as in tests. It goes
    when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    folder = f"{base.rstrip('/')}/tapeloom-{spark.sparkContext.applicationId}"
    if folder not in _made:
        path, fs = _path(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(folder)
    return folder


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files behind."""
    was = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, was)


def collect_garbage(spark: SparkSession) -> None:
    """Lets shuffle files go that no DataFrame or RDD reads any more, as those of a fit, which tidy() does not reach. Python's
    hold on the driver's objects ends in a thread of py4j's that looks once a second."""
    gc.collect()
    time.sleep(1.5)
    spark._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads it: cuts lineage, survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forgets a table that lies in work_dir() under its name, and deletes its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path, fs = _path(spark, f"{work_dir(spark)}/{name}")
    fs.delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more; other files stay."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/tapeloom-{spark.sparkContext.applicationId}/table-" in folder:
            path, fs = _path(spark, folder)
            fs.delete(path, True)
