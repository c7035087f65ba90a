"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staging_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, a folder that every executor and the driver can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return root.rstrip("/")


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate result; it goes when the driver's JVM ends."""
    folder = f"{staging_root(spark)}/tenderflow-{uuid.uuid4().hex}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/{name}"


def stage(df: DataFrame, name: str, by_date: bool = False) -> DataFrame:
    """Write ``df`` as a table of its own in the staging folder and read it back.

    Dated tables are split by date and, within a date, by store and sequence, so a date or
    store with most of the rows is still written by many tasks.
    """
    spark = df.sparkSession
    path = staging_folder(spark, name)
    if by_date:
        spread = df.repartitionByRange("business_date", "rtl_loc_id", "trans_seq")
        spread.write.partitionBy("business_date").parquet(path)
    else:
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored.select(*[F.col(column) for column in df.columns])
