"""Sinks: the latest snapshot, the history of snapshots, and its retention."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


VERSION = "version="
#: Versions that stay when a new one is written: readers that began with the one before may end with it.
KEPT_VERSIONS = 2


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole snapshots below a path, in order."""
    at, system = _file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION))


def _folder(path: str, number: int) -> str:
    return f"{path}/{VERSION}{number:012d}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = KEPT_VERSIONS) -> int:
    """Add a whole snapshot below a path and return its version; write(folder) writes it.

    The new version is written under a hidden name and then renamed to the next number: a reader
    sees the old snapshot or the new one, never a part or none, and a write that fails leaves the
    old one. The largest number is the pointer, so nothing that exists is ever replaced; of two
    writers at once the later takes the number after. The `keep` newest versions stay (0: all).
    """
    pending = f"{path}/.pending-{uuid.uuid4().hex}"
    source, system = _file_system(spark, pending)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    only_new = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        write(pending)
        number = max(versions(spark, path), default=-1) + 1
        while True:
            try:
                context.rename(source, _file_system(spark, _folder(path, number))[0], only_new)
                break
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
                number += 1
    except BaseException:
        system.delete(source, True)
        raise
    for old in versions(spark, path)[:-keep] if keep else ():
        system.delete(_file_system(spark, _folder(path, old))[0], True)
    return number


def latest(spark: SparkSession, path: str, version: int | None = None) -> str:
    """The folder of the latest whole snapshot below a path, or of one version."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no snapshot{'' if version is None else f' of version {version}'} below {path}")
    return _folder(path, known[-1] if version is None else version)


def write_latest(df: DataFrame, path: str, form: str = "parquet", keep: int = KEPT_VERSIONS) -> int:
    """Replace the latest snapshot as a whole (see publish)."""
    return publish(df.sparkSession, path, lambda at: df.write.format(form).save(at), keep)


def read_latest(spark: SparkSession, path: str, form: str = "parquet", version: int | None = None) -> DataFrame:
    """The latest whole snapshot below a path, or the one of a version."""
    return spark.read.format(form).load(latest(spark, path, version))


def write_history(df: DataFrame, path: str, generated_at: str) -> None:
    """Add a snapshot under its time; one of the same second is replaced, all others stay."""
    df.withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generated_at").parquet(path)


def newest(times: DataFrame, column: str, keep: int) -> DataFrame:
    """The `keep` newest distinct values of a column, all of them for 0."""
    distinct = times.select(column).distinct()
    return distinct.orderBy(F.desc(column)).limit(keep) if keep else distinct


def retained(df: DataFrame, column: str, keep: int) -> DataFrame:
    """Rows of the `keep` newest values of a column; only the values are sorted, never the rows."""
    return df.join(F.broadcast(newest(df, column, keep)), column, "left_semi") if keep else df


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _file_system(spark, path)
    return system.exists(at)


def write_sections(rows: DataFrame, path: str, header: DataFrame | None = None, keep: int = KEPT_VERSIONS) -> int:
    """Replace a snapshot of JSON lines as a whole and return its version: a folder for each entry and section (see reports.snapshot_rows).

    header: the one row of reports.header(), which is stored beside the sections.
    """

    def write(at: str) -> None:
        rows.write.partitionBy("ticker", "section").json(f"{at}/rows")
        if header is not None:
            header.coalesce(1).write.json(f"{at}/header")

    return publish(rows.sparkSession, path, write, keep)


def prune_partitions(spark: SparkSession, path: str, column: str, least: str) -> list[str]:
    """Drop the partitions of a column whose value is before `least` and return their names."""
    at, system = _file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    old = sorted(n for n in names if n.startswith(f"{column}=") and n < f"{column}={least}")
    for name in old:
        system.delete(_file_system(spark, f"{path}/{name}")[0], True)
    return old


def prune_history(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Drop all but the `keep` newest partitions of a history and return their names; 0 keeps all."""
    at, system = _file_system(spark, path)
    names = sorted((s.getPath().getName() for s in system.listStatus(at) if s.getPath().getName().startswith("generated_at=")), reverse=True)
    old = names[keep:] if keep else []
    for name in old:
        at, system = _file_system(spark, f"{path}/{name}")
        system.delete(at, True)
    return old
