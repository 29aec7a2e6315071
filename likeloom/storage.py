"""Tables and folders between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="likeloom-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where driver and executors are one process, a temporary folder if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def store_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def workspace(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there goes when the application ends, or with release()."""
    path = f"{shared_folder(spark)}/likeloom-{label}-{uuid.uuid4().hex}"
    store, at = store_of(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back: cuts lineage, survives lost executors, and is the same at every read."""
    spark, path = df.sparkSession, workspace(df.sparkSession, label)
    old = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # else the shuffle files stay until the driver collects its garbage
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes folders of workspace(), or the files of staged tables, that nothing reads any more."""
    for table in tables:
        for path in {table} if isinstance(table, str) else {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            store, at = store_of(spark, path)
            store.delete(at, True)
