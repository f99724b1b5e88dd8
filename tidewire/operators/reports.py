"""Counts over buckets and stories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tallied(routed: DataFrame) -> DataFrame:
    """(watch_ord, ticker, source_name, bucket, bucket_reason, n, article_id) of routed pairs: how many, and the first; a row a source, so it doesn't grow with them."""
    return routed.groupBy("watch_ord", "ticker", "source_name", "bucket", "bucket_reason").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("article_id"))


def ticker_stats(watchlist: DataFrame, tally: DataFrame, stories: DataFrame) -> DataFrame:
    """Counts of each entry, from tallied(), zeros for one without rows. Accepted rows are the primary ones."""
    n = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0))
    rows = tally.groupBy("watch_ord").agg(
        F.sum("n").alias("raw_rows"),
        n("primary").alias("accepted_rows"),
        n("related").alias("related_rows"),
        n("review").alias("review_rows"),
        n("rejected").alias("rejected_rows"),
        n("suppressed").alias("suppressed_rows"),
    )
    clusters = stories.groupBy("watch_ord").agg(F.count(F.lit(1)).alias("story_count"))
    out = watchlist.select("watch_ord", "ticker").join(rows, "watch_ord", "left").join(clusters, "watch_ord", "left").fillna(0)
    return out.withColumn("duplicates_merged", F.greatest(F.col("accepted_rows") - F.col("story_count"), F.lit(0)))


def watchlist_summary(stats: DataFrame) -> DataFrame:
    return stats.select("watch_ord", "ticker", "story_count", "related_rows", "review_rows", "rejected_rows")


def placed_rows(tally: DataFrame, ranked: DataFrame) -> DataFrame:
    """(watch_ord, ticker, bucket, source_name, n, place) of all rows that usage counts, n alike: place is the first's order inside the bucket.

    Primary stands for stories, by their best row's source; related rows by title come before
    those by summary; coverage has each source of a story once.
    """
    first = F.struct(F.when(F.col("bucket_reason") == "summary_only_identity_match", 1).otherwise(0).alias("a"), F.col("article_id").alias("b"), F.lit("").alias("c"))
    columns = ["watch_ord", "ticker", "bucket", "source_name", "n", "place"]
    of = lambda df, bucket: df.withColumn("bucket", F.lit(bucket)).select(*columns)
    rows = tally.withColumn("place", F.when(F.col("bucket") == "related", first).otherwise(F.struct(F.lit(0).alias("a"), F.col("article_id").alias("b"), F.lit("").alias("c"))))
    ranked = ranked.withColumn("n", F.lit(1).cast("bigint"))
    story = ranked.withColumn("place", F.struct(F.lit(0).alias("a"), F.col("story_rank").cast("bigint").alias("b"), F.lit("").alias("c")))
    cover = ranked.withColumn("source_name", F.explode("coverage_sources")).withColumn("place", F.struct(F.lit(0).alias("a"), F.col("story_rank").cast("bigint").alias("b"), F.col("source_name").alias("c")))
    others = rows.where(F.col("bucket").isin("related", "review", "rejected")).select(*columns)
    return of(rows, "raw").union(others).union(of(story, "primary")).union(of(cover, "coverage")).where("source_name <> ''")


def source_usage(placed: DataFrame) -> DataFrame:
    """(watch_ord, ticker, bucket, source_name, n, first_place)."""
    return placed.groupBy("watch_ord", "ticker", "bucket", "source_name").agg(F.sum("n").alias("n"), F.min("place").alias("first_place"))


def usage_ranked(usage: DataFrame) -> DataFrame:
    """Sources of each entry and bucket by count, ties by first appearance."""
    order = Window.partitionBy("watch_ord", "bucket").orderBy(F.desc("n"), "first_place")
    return usage.withColumn("source_rank", F.row_number().over(order)).drop("first_place")


def usage_of_snapshot(tickers: DataFrame) -> DataFrame:
    """(ticker, bucket, source_name, n) of read snapshots: stored counts, or those of the rows where none are stored.

    Raw matches can't be recounted: without stored counts they are missing. The snapshots are
    read once: each row gives its counts, those stored with a number of their own, which keeps them
    apart when the others are summed.
    """
    rows = {"primary_stories": "stories", "related_context": "related_context", "review_candidates": "review_candidates", "rejections": "rejections"}
    count = lambda kind, name, n, own: F.struct(F.lit(kind).alias("bucket"), name.alias("source_name"), n.alias("n"), own.alias("own"))
    none = F.array().cast("array<struct<bucket: string, source_name: string, n: bigint, own: bigint>>")

    def counts(kind: str, names: Column | None) -> Column:
        used = F.col(f"source_usage.{kind}")
        stored = F.transform(F.map_entries(used), lambda e: count(kind, e["key"], e["value"], F.col("__own")))
        again = none if names is None else F.transform(F.filter(names, lambda s: s != ""), lambda s: count(kind, s, F.lit(1).cast("bigint"), F.lit(None).cast("bigint")))
        return F.coalesce(F.when(F.coalesce(F.size(used), F.lit(0)) > 0, stored).otherwise(again), none)

    names = {kind: F.transform(field, lambda r: r["source_name"]) for kind, field in rows.items()}
    names["primary_story_coverage"] = F.flatten(F.transform("stories", lambda r: F.coalesce(r["coverage_sources"], F.array().cast("array<string>"))))
    numbered = tickers.withColumn("__own", F.monotonically_increasing_id())
    each = numbered.select("ticker", F.explode(F.concat(counts("raw_matches", None), *(counts(k, c) for k, c in names.items()))).alias("u"))
    return each.groupBy("ticker", "u.bucket", "u.source_name", "u.own").agg(F.sum("u.n").alias("n")).drop("own")


#: Sections of a snapshot that hold rows of articles, by bucket.
SECTIONS = {"primary": "stories", "related": "related_context", "review": "review_candidates", "rejected": "rejections"}
#: Names of the buckets of source usage in a snapshot.
USED = {"raw": "raw_matches", "primary": "primary_stories", "related": "related_context", "review": "review_candidates", "rejected": "rejections", "coverage": "primary_story_coverage"}
COLUMNS = ["watch_ord", "ticker", "section", "place", "title", "link", "source_key", "source_name", "relevance_score", "event_type", "n", "notes"]


def snapshot_rows(watchlist: DataFrame, stats: DataFrame, routed: DataFrame, ranked: DataFrame, usage: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """A snapshot of all entries in flat rows, so that none grows with the articles.

    Sections of an entry: `profile` (title: company, notes: keywords), `stats` (title: a count's
    name, n), `source_usage` (title: bucket, source_name, n), `failures` (source_key, n; the same for
    every entry), `stories` in rank order (n: coverage, notes: its sources), and the related,
    review and rejected rows in their order (notes: reasons). `place` orders a section.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("title", "string"), ("link", "string"), ("source_key", "string"), ("source_name", "string"), ("relevance_score", "double"), ("event_type", "string"), ("n", "bigint"), ("notes", "array<string>"))}

    def part(df: DataFrame, section: Column, place: Column, **given: Column) -> DataFrame:
        made = {**none, **given, "section": section, "place": place.cast("bigint")}
        return df.select(*(made[c].alias(c) if c in made else F.col(c) for c in COLUMNS))

    counts = [c for c in stats.columns if c not in ("watch_ord", "ticker")]
    listed = F.posexplode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in counts)))
    stat = stats.select("watch_ord", "ticker", listed.alias("at", "x"))
    rows = routed.where(F.col("bucket").isin(*(b for b in SECTIONS if b != "primary")))
    row = {c: F.col(c) for c in ("title", "link", "source_key", "source_name", "relevance_score", "event_type")}
    named = lambda names: F.coalesce(*(F.when(F.col("bucket") == b, s) for b, s in names.items()))
    second = F.when(F.col("bucket_reason") == "summary_only_identity_match", F.lit(1 << 62)).otherwise(F.lit(0))  # after those by title
    out = [
        part(watchlist, F.lit("profile"), F.lit(0), title=F.col("company"), notes=F.col("keywords")),
        part(stat, F.lit("stats"), F.col("at"), title=F.col("x.name"), n=F.col("x.n")),
        part(usage, F.lit("source_usage"), F.lit(0), title=named(USED), source_name=F.col("source_name"), n=F.col("n")),
        part(ranked, F.lit("stories"), F.col("story_rank"), **row, n=F.col("coverage_count").cast("bigint"), notes=F.col("coverage_sources")),
        part(rows, named(SECTIONS), second + F.col("article_id"), **row, notes=F.when(F.col("bucket") == "rejected", F.col("rejection_reasons")).otherwise(F.array("bucket_reason"))),
    ]
    if failures is not None:  # a row a source at most, met by every entry
        few = F.broadcast(failures.where("failed > 0").select("source_key", "failed"))
        out.append(part(watchlist.select("watch_ord", "ticker").join(few, F.lit(True)), F.lit("failures"), F.lit(0), source_key=F.col("source_key"), n=F.col("failed").cast("bigint")))
    return reduce(DataFrame.union, out)


def header(generated_at: str, watchlist_file: str, rss_limit: int, structured_limit: int, include_seen: bool, spark: SparkSession) -> DataFrame:
    """The one row that a snapshot begins with."""
    row = (generated_at, watchlist_file, rss_limit, structured_limit, include_seen)
    return spark.createDataFrame([row], "generated_at string, watchlist_file string, rss_limit int, structured_limit int, include_seen boolean")


def usage_of_sections(rows: DataFrame) -> DataFrame:
    """(ticker, bucket, source_name, n) of a flat snapshot: stored counts, or those of the rows where an entry has none of a bucket.

    Raw matches can't be recounted: without stored counts they are missing.
    """
    stored = rows.where("section = 'source_usage'").select("ticker", F.col("title").alias("bucket"), "source_name", "n")
    known = stored.select("ticker", "bucket").distinct()
    bucket = F.when(F.col("section") == "stories", "primary_stories").otherwise(F.col("section"))
    names = rows.where(F.col("section").isin(*SECTIONS.values())).select("ticker", bucket.alias("bucket"), "source_name")
    cover = rows.where("section = 'stories'").select("ticker", F.lit("primary_story_coverage").alias("bucket"), F.explode("notes").alias("source_name"))
    found = names.union(cover).where("source_name <> ''").join(F.broadcast(known), ["ticker", "bucket"], "left_anti")
    return stored.union(found.groupBy("ticker", "bucket", "source_name").agg(F.count(F.lit(1)).alias("n")))
