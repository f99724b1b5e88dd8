"""Links already seen on a day, and the first watchlist entry to claim a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dimension import STRUCTURED


def _key(df: DataFrame) -> list[str]:
    return ["seen_day", "link"] if "seen_day" in df.columns else ["link"]


def unseen(rows: DataFrame, seen: DataFrame, day: str | None = None) -> DataFrame:
    """Rows of news sites whose link, as it is, was not seen before; feed articles always go on.

    A link was seen if `seen` (seen_day, link) has it on `day`, or without one on the row's
    own seen_day.
    """
    key = ["link"] if day else ["seen_day", "link"]
    known = seen.where(F.col("seen_day") == F.lit(day).cast("date")) if day else seen
    known = known.select(*key).distinct().withColumn("__seen", F.lit(True))
    return rows.join(known, key, "left").where((F.col("source_group") != STRUCTURED) | F.col("__seen").isNull()).drop("__seen")


def first_claim(pairs: DataFrame) -> DataFrame:
    """Pairs without those whose link an earlier entry has claimed; feed articles are exempt, an empty link counts.

    With a column seen_day, claims hold for the day. The claim of a link is summed first and
    then joined, so a frequent link is no window group.
    """
    claim = pairs.where(F.col("source_group") == STRUCTURED).groupBy(*_key(pairs)).agg(F.min("watch_ord").alias("__first"))
    return pairs.join(claim, _key(pairs), "left").where((F.col("source_group") != STRUCTURED) | (F.col("watch_ord") == F.col("__first"))).drop("__first")
