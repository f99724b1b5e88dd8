"""Continuous runs over landed article files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshot import Snapshot
from ..sources.dimension import STRUCTURED
from ..sources.staging import release, staged
from ..sources.writers import exists, prune_history, prune_partitions, write_history, write_latest
from .claims import dated, settled


def first_seen(links: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each (day, link) of a stream with columns ts and link.

    State is keyed by the day and leaves with the watermark; rows later than that are dropped.
    """
    return links.withWatermark("ts", delay).withColumn("seen_day", F.to_date("ts")).dropDuplicatesWithinWatermark(["seen_day", "link"])


def _stored(job: Snapshot, out: str, number: int, keep: int) -> None:
    ranked = job.ranked = staged(job.ranked)  # a batch without stories leaves an empty latest table and no history
    write_history(ranked, f"{out}/history", f"{number:08d}")
    write_latest(ranked, f"{out}/latest")
    prune_history(ranked.sparkSession, f"{out}/history", keep)
    job.usage.drop("first_place").write.mode("overwrite").parquet(f"{out}/usage/batch={number}")
    job.release()


def refresh(watchlist: DataFrame, out: str, keep: int = 30, include_seen: bool = False, seen_days: int = 2, today: Callable[[int], str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's stories to out/latest and out/history, its claimed links to out/seen, its source usage to out/usage.

    The day of a link is the day its article was published, in UTC (functions.dates: any form);
    one whose date is blank or can't be read has the day of its batch, which today(number) gives
    (the current date if there is none). Earlier batches claim a link first; a batch that runs
    again replaces what it wrote, its own links don't count as seen.

    Links are kept in a folder for each batch, below its newest day. A batch reads the folders and
    rows of its own days only; afterwards the folders that end before the newest seen_days days
    are dropped (0: none), so what is kept does not grow with time. `refresh_claimed` needs no such
    table.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, links = batch.sparkSession, None
        rows = dated(batch, F.lit(today(number)) if today else None)
        days = rows.agg(F.min("seen_day"), F.max("seen_day")).first()
        at = f"{out}/seen"
        if not include_seen:
            links = spark.createDataFrame([], "seen_day date, link string")
            if exists(spark, at):
                of_days = (F.col("until") >= F.lit(days[0])) & F.col("seen_day").between(F.lit(days[0]), F.lit(days[1]))
                links = spark.read.schema("link string, seen_day date, until date, batch long").parquet(at).where(of_days & (F.col("batch") < number)).select("seen_day", "link")
        job = Snapshot(rows, watchlist, links)
        if not include_seen:  # all pairs are in the scored ones, which are written here
            claimed = job.scored.where(F.col("source_group") == STRUCTURED).select("link", "seen_day").distinct()
            if days[1]:
                claimed.write.mode("overwrite").parquet(f"{at}/until={days[1]}/batch={number}")
            if days[1] and seen_days:
                prune_partitions(spark, at, "until", str(days[1] - timedelta(days=seen_days - 1)))
        _stored(job, out, number, keep)

    return run


def refresh_claimed(watchlist: DataFrame, out: str, keep: int = 30) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for claims.claimed_pairs(): as refresh, with first claims from the stream's own state.

    The state knows which links earlier batches have, so no table of seen links is read or
    written; a batch that runs again gets the same claims again.
    """

    def run(batch: DataFrame, number: int) -> None:
        both = staged(batch)  # the state is advanced once
        job = Snapshot(both, watchlist)
        job.pairs = settled(both)
        _stored(job, out, number, keep)
        release(both)

    return run


USAGE = "watch_ord int, ticker string, bucket string, source_name string, n bigint"


def fold_usage(spark: SparkSession, usage: str, out: str) -> None:
    """Fold the counts that batches left in `usage` into the totals at out/latest, each once.

    A stream reads what is new there and adds it to its state, a row for each entry, bucket and
    source; no batch or history is counted again.
    """
    new = spark.readStream.schema(USAGE).option("recursiveFileLookup", True).parquet(usage)
    totals = new.groupBy("watch_ord", "ticker", "bucket", "source_name").agg(F.sum("n").alias("n"))
    to = totals.writeStream.outputMode("complete").foreachBatch(lambda df, _: write_latest(df, f"{out}/latest"))
    to.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def mark_collected(headlines: DataFrame, at: str, day: str) -> DataFrame:
    """Headlines whose link was not collected before on that day; all of their links then count as collected.

    The state of a collector without a watchlist: every collected link is marked, matched or not.
    Other days' links are dropped.
    """
    spark = headlines.sparkSession
    known = spark.createDataFrame([], "link string, seen_day date")
    if exists(spark, at):
        known = spark.read.schema("link string, seen_day date").parquet(at)
    fresh = staged(headlines.join(known.where(F.col("seen_day") == F.lit(day).cast("date")).select("link").distinct(), "link", "left_anti").select(*headlines.columns))
    fresh.select("link", F.lit(day).cast("date").alias("seen_day")).distinct().write.mode("append").partitionBy("seen_day").parquet(at)
    prune_partitions(spark, at, "seen_day", day)
    return fresh
