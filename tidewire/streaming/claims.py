"""First claims of links across the batches of a stream, in keyed state with timers.

The state is one row for each (day, link): that somebody has it. It lives in the state store
(RocksDB, see `rocksdb`), is written batch by batch and leaves by timer once the watermark has
passed the day. Nothing is read back or rewritten as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import published_at, utc_day
from ..functions.text import filled
from ..operators import matching, profiles, scoring
from ..sources.dimension import STRUCTURED

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLAIM = "seen_day date, link string, watch_ord int"


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state with timers needs.

    partitions: of the state, by which a stream stays once it has begun; as many as the cluster has cores if not given.
    """
    wanted = {PROVIDER: ROCKSDB, "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FirstClaim(StatefulProcessor):
    """Gives (day, link) to the smallest watch_ord of the first batch that has it; later batches get nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "watch_ord int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.taken.exists():
            return
        first = min(r["watch_ord"] for r in rows)  # one pass, nothing kept
        self.taken.update((first,))
        day = datetime(key[0].year, key[0].month, key[0].day, tzinfo=timezone.utc)
        self.handle.registerTimer(int((day + timedelta(days=1)).timestamp() * 1000))
        yield Row(seen_day=key[0], link=key[1], watch_ord=first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest watch_ord of each (day, link) of a batch, so that a hot link is few rows before they are shuffled."""
    for batch in batches:
        made = pa.Table.from_batches([batch]).group_by(["seen_day", "link"]).aggregate([("watch_ord", "min")])
        yield from made.rename_columns(["seen_day", "link", "watch_ord"]).to_batches()


def first_claims(wanted: DataFrame, delay: str = "1 day") -> DataFrame:
    """(seen_day, link, watch_ord): of a stream of such rows the first claim of each link and day.

    A day's state goes once rows of a day more than `delay` later have come; rows of days that
    are gone make no claim.
    """
    few = wanted.select("seen_day", "link", "watch_ord").mapInArrow(_least, CLAIM)
    # the moment is the day's last, so that a day is over for all of its rows at once
    moment = F.timestamp_add("SECOND", F.lit(86399), F.col("seen_day").cast("timestamp"))
    timed = few.withColumn("seen_at", moment).withWatermark("seen_at", delay)
    return timed.groupBy("seen_day", "link").transformWithState(FirstClaim(), CLAIM, "Append", "EventTime")


def dated(articles: DataFrame, today: Column | None = None) -> DataFrame:
    """articles with published_at and seen_day, the day in UTC; a date that is blank or can't be read gets the day of its batch."""
    moment = published_at(F.col("published"))
    return articles.withColumn("published_at", moment).withColumn("seen_day", F.coalesce(utc_day(F.col("published_at")), F.current_date() if today is None else today.cast("date")))


def claimed_pairs(articles: DataFrame, watchlist: DataFrame, delay: str = "1 day", today: Column | None = None) -> DataFrame:
    """A stream of articles as their pairs with the watchlist (claim: null) and the first claims among these (claim: watch_ord).

    foreachBatch gets both and keeps of the news sites' pairs those with a claim (`settled`);
    only claims pass through the state, pairs never move.
    """
    pairs = matching.candidate_pairs(scoring.prepared(dated(articles, today)), profiles.needles(profiles.profiles(watchlist)))
    wanted = pairs.where(F.col("source_group") == STRUCTURED).withColumn("link", filled(F.col("link")))
    claims = first_claims(wanted, delay).withColumnRenamed("watch_ord", "claim")
    return pairs.withColumn("claim", F.lit(None).cast("int")).unionByName(claims, allowMissingColumns=True)


def settled(batch: DataFrame) -> DataFrame:
    """The pairs of a batch of claimed_pairs without those whose link another entry or an earlier batch has; feed articles are exempt."""
    claims = batch.where("claim IS NOT NULL").select("seen_day", F.col("link").alias("__link"), F.col("claim").alias("watch_ord"), F.lit(True).alias("__first"))
    pairs = batch.where("claim IS NULL").drop("claim").withColumn("__link", filled(F.col("link")))
    out = pairs.join(claims, ["seen_day", "__link", "watch_ord"], "left")
    return out.where((F.col("source_group") != STRUCTURED) | F.col("__first")).drop("__link", "__first")
