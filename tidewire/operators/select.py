"""Which rows go on: caps, wanted links, first occurrences, dates, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from ..sources.dimension import ANY_LINK, with_source


def cap_per_source(df: DataFrame, n: int, order: str = "article_id") -> DataFrame:
    """The first n rows of each source; each partition keeps n of a source before any are moved. 0: all."""
    if not n:
        return df
    first = Window.partitionBy("source_key").orderBy(order)
    return df.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= n).drop("__n")


def wanted_links(df: DataFrame, link: str = "link") -> DataFrame:
    """Rows whose link has one of its source's wanted parts; no parts, or an exempt source: all."""
    out = with_source(df, "href_contains")
    some = F.col("href_contains")
    ok = some.isNull() | (F.size(some) == 0) | F.col("source_key").isin(ANY_LINK) | F.exists(some, lambda p: F.contains(filled(F.col(link)), p))
    return out.where(ok).drop("href_contains")


def first_per_link(df: DataFrame, order: str, link: str = "link") -> DataFrame:
    """The first row of each link of a source. Links are first reduced to their earliest place, then met again."""
    first = df.groupBy("source_key", link).agg(F.min(order).alias(order))
    return df.join(first, ["source_key", link, order], "left_semi")


def in_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows from the start day to the end day, both included; the bare column meets the bounds, so files are pruned."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def combined(*parts: DataFrame) -> DataFrame:
    """All rows of tables with different columns; a missing text is ''."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).fillna("", [c for c in ("title", "summary", "link", "published", "text") if any(c in p.columns for p in parts)])
