"""The folder that the driver and all executors share, for tables that cut a plan and for what a stream writes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application's own, in the folder that spark.checkpoint.dir names. Where none is named,
    in a temporary one if the executors are threads of the driver (tests); on a cluster, an error.

    The application's folder goes when its driver ends, with what a failed query has left there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not hasattr(shared_path, "fallback"):
            shared_path.fallback = tempfile.mkdtemp(prefix="bourse-")
        named = shared_path.fallback
    own = f"{named.rstrip('/')}/bourse-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "bourse_folder", None) != own:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        spark.sparkContext.bourse_folder = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Removes a table made by ``staged`` which nothing reads any more."""
    if getattr(df, "_staged", None):
        remove(df.sparkSession, df._staged)
