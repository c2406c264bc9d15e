"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session in spark.checkpoint.dir, which driver and executors share.

    The setting is the cluster's. Only a session without one, as in tests, gets
    a temporary folder, which is right only where all tasks run on one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp())
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write df to the shared folder with one file for each bucket of key; grouping by key needs no shuffle then.

    There are no more buckets than the session allows: beyond that buckets get
    larger, and a task still reads its bucket one key after the other. The table
    leaves the catalog at once, as its files are read by their own list.
    """
    spark = df.sparkSession
    buckets = max(1, min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found
