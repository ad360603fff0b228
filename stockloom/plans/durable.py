"""Lineage cuts that survive lost executors.

Tables are written as Parquet below ``spark.checkpoint.dir`` and read back. Every executor must
see that folder. Where the setting is missing, a local
folder serves a local master (tests, notebooks); on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or "file://" + os.path.join(tempfile.gettempdir(), "stockloom")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a reader of the copy; later jobs do not recompute it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str = "stage") -> DataFrame:
    """Like ``staged``, but dealt by ``key``: a join by it moves the other side only, however large the rows of this one are."""
    spark = df.sparkSession
    path, many = fresh_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").bucketBy(many, key).option("path", path).saveAsTable(name)
    return spark.table(name)
