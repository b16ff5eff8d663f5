"""Session helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, which the session names in spark.checkpoint.dir.

    Only a local session may go without: its folder is on the one machine there is.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, in whatever store it is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder, so that it isn't computed again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a packed table of the checkpoint folder, and where it is, for `remove`."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffles and checkpoints that nothing refers to any more; else they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def buckets_of(spark: SparkSession, n_bytes: float, target_bytes: int) -> int:
    """Buckets of about target_bytes for n_bytes, never fewer than the shuffle partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // target_bytes + 1))


def buckets_for(df: DataFrame, blow_up: float, target_bytes: int) -> int:
    """Buckets of about target_bytes for blow_up times the estimated size of df."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(buckets_of(df.sparkSession, size * blow_up, target_bytes), 1 << 24)


def key_columns(documents: DataFrame) -> tuple[Column, Column, bool]:
    """The key of a row: its id (null: the smallest long) and, where ids repeat, a hash of its text; and whether they do.

    Rows that agree in both are repeats of one document and get one result each.  Where all
    ids differ, the hash is 0: it would only be eight more bytes of everything that travels.
    """
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    repeated = documents.groupBy(row_id.alias("row_id")).count().where("count > 1").limit(1).count() > 0
    return row_id, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if repeated else F.lit(0).cast("long"), repeated


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and the key of a row as row_id and row_hash."""
    row_id, row_hash, _ = key_columns(documents)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_id.alias("row_id"), row_hash.alias("row_hash"))


def with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed documents with `spans`: the list of int32 (start, end) blobs that concern the row."""
    found = spans.groupBy("row_id", "row_hash").agg(F.collect_list("span_blob").alias("spans"))
    return documents.join(found, ["row_id", "row_hash"], "left").select("doc_id", "text", "spans")
