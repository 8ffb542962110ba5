"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of this process's tables, below the shared folder.
_OWN = f"quillon-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only on one machine (master local) it may be unset: then a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{_OWN}"


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._quillon_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs; it does so only when the driver's JVM collects their handles."""
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Deletes the table of a stash that nothing reads any more, and frees shuffle files."""
    _delete(df.sparkSession, df._quillon_at)
    free(df.sparkSession)


def drop_stashes(spark: SparkSession) -> None:
    """Deletes all tables that this process has written, and nothing else; call it when no result that reads them is needed any more."""
    _delete(spark, folder(spark))
