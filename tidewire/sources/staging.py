"""Tables written once between the phases of a job, so that several outputs share them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_root(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares (spark.checkpoint.dir).

    A local one only where none is named and all runs on one machine; on a cluster that is an
    error, as it is where the session doesn't say what it runs on.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "") or ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = spark.conf.get("spark.tidewire.ownFolder", None) or "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.tidewire.ownFolder", root)
    return f"{root}/tidewire/{spark.conf.get('spark.app.id', 'local')}"


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder there."""
    return f"{own_root(spark)}/news/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that the news jobs of this application have written there; call it when their results are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{own_root(spark)}/news")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: later steps read the columns they need, and a lost executor loses none of it."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    made = df.sparkSession.read.schema(df.schema).parquet(at)
    made._staged_at = at
    return made


def release(*tables: DataFrame) -> None:
    """Delete what staged() has written for these tables; others are left alone."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one part: what a task makes of some hundred thousand articles takes it half a minute or so.
PART_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """df in parts of PART_ROWS rows at most, or of fewer where cores would be idle, so that no task grows with the table; one of as many parts stays as it is."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
