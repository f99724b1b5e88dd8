"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Characters of text that one numpy step holds at once, whatever the Arrow batch size is.
CHUNK_CHARS = 2_000_000
#: Bytes of rows after which an Arrow batch is closed; Spark's own bounds are 64 MB and 10,000 rows.
BATCH_BYTES = 4_000_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    One of our own only where that is unset and all runs on one machine; on a cluster that is an
    error, as no executor sees what another writes to its own disk, and so it is where the session
    doesn't say what it runs on.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.tidewire.ownCheckpointDir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tidewire-checkpoint-")
        spark.conf.set("spark.tidewire.ownCheckpointDir", root)
    return root


def own_folder(spark: SparkSession) -> str:
    """This application's folder there; other applications share the place, not the folder."""
    return f"{shared_folder(spark)}/tidewire/{spark.conf.get('spark.app.id', 'local')}/llm"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to the shared folder and read it back.

    The files outlive any executor, so a later stage never recomputes what stands above, and
    the shuffle files of the write are removed with its end (where the setting is known).
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._tidewire_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Drop the files of tables that materialise() gave and that nothing yet to run reads."""
    for t in tables:
        _delete(t.sparkSession, t._tidewire_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Drop what materialise() has written for this application; call it once the results are stored."""
    _delete(spark, own_folder(spark))


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold about BATCH_BYTES at most; a bound that the user has set stays.

    An executor holds a batch outside its heap, once or twice, and so does its worker, for each
    task that runs. Spark reads the setting as a query begins, so it is left for what is returned.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def slices(batch: pa.RecordBatch, text_col: str, size: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about `size` bytes of text, or with one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def others(df: DataFrame, new: list[str], *kept: str) -> list[str]:
    """Columns of df whose names aren't among the new ones, whatever the case; `kept` stay."""
    taken = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in taken or c in kept]


def append(df: DataFrame, text_col: str, fields: str, start: Callable[[], Callable[[list[str]], list]], size: int = CHUNK_CHARS) -> DataFrame:
    """df with columns made from its texts, in Arrow batches; a null text is ''.

    start() is called once a task and gives the function from texts to one Arrow array (or
    list) for each of `fields` (a DDL string). Columns of df pass through unread; one that has
    the name of a new column is replaced by it. The function gets about `size` bytes of text at once.
    """
    bound_batches(df.sparkSession)
    new = StructType.fromDDL(fields)
    df = df.select(*others(df, new.names, text_col))
    schema = StructType([*df.schema.fields, *new.fields])
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for part in slices(batch, text_col, size):
                made = f([t or "" for t in part.column(text_col).to_pylist()])
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *new.names])

    return df.mapInArrow(run, schema)


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is null or on several rows."""
    return docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__tw_n")).where((F.col("__tw_n") > 1) | F.col(id_col).isNull()).isEmpty()


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (doc, id, text) with doc unique: the id itself, or a number given once and written where ids repeat."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if dict(few.dtypes)["id"] in ("bigint", "int") and unique_ids(few, "id"):
        return few.select(F.col("id").cast("bigint").alias("doc"), "id", "text")
    return materialise(few.withColumn("doc", F.monotonically_increasing_id()), "identified")
