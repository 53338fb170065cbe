"""Intermediate tables in the cluster's shared folder.

An iterative or multi-use result is written once and read back. That cuts its
lineage, survives the loss of executors, freezes row ids, and gives Catalyst the
true size of the table, on which its choice of broadcast or shuffle join rests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table, by rows, that an explicit broadcast hint may name. The tables it is used for have two or
# three narrow columns, of 60 to 100 bytes a row where they are looked up. A join that shuffles
# moves all pairs of words or all words of the text instead.
BROADCAST_ROWS = 4_000_000

# Largest part of a dense operand, in bytes, that is broadcast at a time.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyvec/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n_rows: int | None) -> DataFrame:
    """Hint a broadcast when the known row count allows it; otherwise leave it to Catalyst."""
    if n_rows is not None and n_rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input that scans as fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *keys)
    return df
