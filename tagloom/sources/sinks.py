"""Scratch folders and tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="spark-tagloom-")
    return f"{base.rstrip('/')}/tagloom-{uuid.uuid4().hex}"


def settle(frame: DataFrame) -> DataFrame:
    """The rows written to a scratch folder and read again: no lineage, and nothing to compute anew when an executor is lost."""
    path = scratch(frame.sparkSession)
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """``frame``, dealt anew where a scan gives fewer partitions than there are cores (a small table in one row group); for work that costs far more than a shuffle of its rows."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())
