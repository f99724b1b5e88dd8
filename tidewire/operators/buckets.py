"""Routing of scored pairs: primary, related, review, rejected, or suppressed by an equal row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.staging import staged

#: Keys up to which those that make others give way are broadcast (some 40 bytes each).
BROADCAST_KEYS = 500_000
KEY = ["watch_ord", "canonical_link", "title_key", "title"]
TITLE, SUMMARY, REVIEW = "title_pattern", "summary_only_identity_match", "borderline_but_relevant"


def flagged(scored: DataFrame) -> DataFrame:
    has = lambda reason: F.array_contains("rejection_reasons", reason)
    acc, roundup = F.col("accepted"), has("broad_roundup_pattern") | has("roundup_without_focus")
    title = acc & (F.col("__context") | (F.col("event_type") == "comparison_or_context"))
    by_summary = ~acc & (F.size("matched_identity") > 0) & ~roundup & has("no_title_focus") & (F.col("relevance_score") >= rules.RELATED) & ~has("weak_aggregator_match")
    review = ~acc & ~roundup & (F.col("relevance_score") >= rules.REVIEW) & ((F.size("matched_identity") > 0) | (F.size("matched_specific") > 0))
    return scored.withColumns({"__related": F.when(title, TITLE).when(by_summary, SUMMARY), "__review": review})


#: What a pair's bucket depends on besides `accepted`: numbers and flags, so that no text is read for it.
MARKS = ["__related", "__review", "__h1", "__h2"]


def marked(scored: DataFrame) -> DataFrame:
    """scored with MARKS; __h1 and __h2 are 128 bits of a pair's key."""
    return flagged(scored).withColumns({"__h1": F.xxhash64(*KEY), "__h2": F.xxhash64(F.lit(1), *KEY)})


def routed(scored: DataFrame) -> DataFrame:
    """marked() pairs with bucket and reason, without the marks.

    A row that is not accepted gives way to related rows with its key (link, title key and
    title of the entry), then to rows under review; it becomes `suppressed` if it is neither
    itself. The keys that make others give way are summed to one row each before they meet
    the pairs, so a release that thousands of sites carry is never one task's group. Keys meet by
    128 bits of theirs; up to BROADCAST_KEYS of them pairs don't move.
    """
    hashes = ["__h1", "__h2"]
    related = F.col("__related").isNotNull()
    strong = staged(scored.where(related | F.col("__review")).groupBy(*hashes).agg(F.max(related).alias("__has_related"), F.max("__review").alias("__has_review")))
    few = strong.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    out = scored.join(F.broadcast(strong) if few else strong, hashes, "left").drop(*hashes)
    none = lambda c: ~F.coalesce(c, F.lit(False))
    free = none(F.col("__has_related"))
    bucket = (
        F.when(related, "related")
        .when(F.col("accepted"), "primary")
        .when(free & F.col("__review"), "review")
        .when(free & none(F.col("__has_review")), "rejected")
        .otherwise("suppressed")
    )
    out = out.withColumn("bucket", bucket)
    reason = F.when(related, F.col("__related")).when(F.col("bucket") == "review", REVIEW)
    return out.withColumn("bucket_reason", reason).drop("__related", "__review", "__has_related", "__has_review")
