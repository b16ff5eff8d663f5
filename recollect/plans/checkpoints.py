"""Cutting of lineage through the shared checkpoint folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; only a local session may go without naming one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """df as a packed table of the shared folder, and where it is; it stays until `dropped`."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more, and lets go of shuffles that made it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffles and checkpoints that nothing refers to any more; else they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
