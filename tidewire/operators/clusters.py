"""Story clusters of primary rows and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import first_filled, rounded
from ..sources.dimension import with_source


def keyed(primary: DataFrame) -> DataFrame:
    """primary with cluster_key: a title key that several rows of the entry share, else link, title key, link as given, title.

    Shared title keys are counted with partial sums and joined back, so a hot title is no
    single window group.
    """
    shared = primary.where("title_key <> ''").groupBy("watch_ord", "title_key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n").withColumn("__shared", F.lit(True))
    out = primary.join(shared, ["watch_ord", "title_key"], "left")
    own = first_filled(F.col("canonical_link"), F.col("title_key"), F.col("link"), F.col("title"))
    return out.withColumn("cluster_key", F.when(F.col("__shared"), F.concat(F.lit("title:"), "title_key")).otherwise(own)).drop("__shared")


def stories(primary: DataFrame) -> DataFrame:
    """One row a cluster: its best row (score, source priority, then the earliest), coverage and signal strength."""
    rows = with_source(keyed(primary), "priority")
    some = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
    best = F.struct("article_id", "title", "summary", "link", "published", "source_key", "source_name", "relevance_score", "event_type", "event_weight")
    out = rows.groupBy("watch_ord", "ticker", "cluster_key").agg(
        F.count(F.lit(1)).alias("coverage_count"),
        F.max_by(best, F.struct("relevance_score", "priority", -F.col("article_id"))).alias("best"),
        F.min("article_id").alias("first_ord"),
        some("source_name").alias("coverage_sources"),
        some("source_key").alias("coverage_source_keys"),
        some("canonical_link").alias("duplicate_links"),
        some("title").alias("merged_titles"),
    )
    signal = F.col("best.relevance_score") * F.col("best.event_weight") * (F.lit(1.0) + F.lit(rules.COVERAGE_STEP) * (F.col("coverage_count") - 1))
    return out.select("watch_ord", "ticker", "cluster_key", "best.*", "coverage_count", "first_ord", "coverage_sources", "coverage_source_keys", "duplicate_links", "merged_titles", rounded(signal).alias("signal_strength"))


def members(primary: DataFrame, of_stories: DataFrame) -> DataFrame:
    """A row for each row of a story, whatever its size: (watch_ord, ticker, cluster_key, article_id, source_key, source_name, canonical_link, title, is_best).

    Nothing is gathered, so a story that a hundred thousand sites carry is as many rows.
    """
    best = of_stories.select("watch_ord", "article_id", F.lit(True).alias("is_best"))
    rows = keyed(primary).select("watch_ord", "ticker", "cluster_key", "article_id", "source_key", "source_name", "canonical_link", "title")
    return rows.join(best, ["watch_ord", "article_id"], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def member_values(rows: DataFrame) -> DataFrame:
    """(watch_ord, ticker, cluster_key, kind, value, n): how often the members of a story have a source, link or title."""
    kinds = {"source": "source_name", "link": "canonical_link", "title": "title"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()))).alias("v")
    return rows.select("watch_ord", "ticker", "cluster_key", each).where("v.value <> ''").groupBy("watch_ord", "ticker", "cluster_key", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n"))


def member_counts(rows: DataFrame) -> DataFrame:
    """(watch_ord, ticker, cluster_key, n_rows, n_sources, n_links, n_titles), summed in two steps: by value, then by story."""
    values = member_values(rows)
    of = lambda kind, what: F.coalesce(F.sum(F.when(F.col("kind") == kind, what)), F.lit(0))
    return values.groupBy("watch_ord", "ticker", "cluster_key").agg(of("source", F.col("n")).alias("n_rows"), of("source", 1).alias("n_sources"), of("link", 1).alias("n_links"), of("title", 1).alias("n_titles"))


#: Stories of an entry that are ranked in one part; sampled stories that cut larger ones.
PART, SAMPLED = 200_000, 20_000


def ranked(clusters: DataFrame, k: int = 0, part: int = PART) -> DataFrame:
    """Clusters with their story_rank in the entry: signal, coverage, then first appearance. k: only the k best.

    With k, each partition keeps its own k best first. Without, an entry of more than `part`
    stories is cut to ranges of its order, by a sample of it; ranges are counted, and a rank is the
    place inside the range plus the sizes of those before. Nothing is written in between.
    """
    order = [*map(F.desc, ("signal_strength", "coverage_count")), F.asc("first_ord")]
    if k:
        best = Window.partitionBy("watch_ord").orderBy(*order)
        return clusters.withColumn("story_rank", F.row_number().over(best)).where(F.col("story_rank") <= k)
    large = {r[0]: r[1] for r in clusters.groupBy("watch_ord").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).collect()}  # one in `part` stories at most
    if not large:
        return clusters.withColumn("story_rank", F.row_number().over(Window.partitionBy("watch_ord").orderBy(*order)))
    placed = clusters.withColumn("__key", F.struct((-F.col("signal_strength")).alias("a"), (-F.col("coverage_count")).alias("b"), F.col("first_ord").alias("c")))
    placed = placed.join(F.broadcast(_cuts(placed, large, part)), "watch_ord", "left")
    placed = placed.withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col("__key"))), F.lit(0))).drop("__cuts", "__key")
    sizes = placed.groupBy("watch_ord", "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row an entry and range
    before = Window.partitionBy("watch_ord").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").where("__before > 0")
    inside = Window.partitionBy("watch_ord", "__part").orderBy(*order)
    out = placed.withColumn("__place", F.row_number().over(inside)).join(F.broadcast(sizes), ["watch_ord", "__part"], "left")
    return out.withColumn("story_rank", (F.coalesce("__before", F.lit(0)) + F.col("__place")).cast("int")).drop("__before", "__place", "__part")


def _cuts(placed: DataFrame, large: dict[int, int], part: int) -> DataFrame:
    """(watch_ord, cuts): for each large entry keys that cut it to parts, from a sample of about SAMPLED stories."""
    every = max(1, sum(large.values()) // SAMPLED)
    some = placed.where(F.col("watch_ord").isin(list(large)) & (F.pmod(F.xxhash64("watch_ord", "first_ord"), F.lit(every)) == 0)).select("watch_ord", "__key")
    keys: dict[int, list] = {}
    for entry, key in some.collect():
        keys.setdefault(entry, []).append(tuple(key))
    cuts = []
    for entry, listed in keys.items():
        listed.sort()
        parts = min(-(-large[entry] // part), len(listed))
        cuts.append((entry, [listed[i * len(listed) // parts] for i in range(1, parts)]))
    kind = placed.schema["__key"].dataType.simpleString()
    return placed.sparkSession.createDataFrame(cuts, f"watch_ord int, __cuts array<{kind}>")
