"""The watchlist job: from articles and a watchlist to ranked stories, buckets and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import buckets, clusters, matching, profiles, reports, scoring, seen
from ..sources.staging import release, spread, staged

#: What the tables after scoring need of a pair.
SCORED = [
    *("article_id", "watch_ord", "ticker", "source_group", "source_key", "source_name", "title", "summary", "link", "published"),
    *("event_type", "event_weight", "__context", "canonical_link", "title_key", "relevance_score"),
    *("matched_identity", "matched_specific", "matched_generic", "rejection_reasons", "accepted"),
    *buckets.MARKS,
]

#: What streams keep of it besides.
DATED = ["seen_day"]
#: What counts need of a routed pair.
COUNTED = ["article_id", "watch_ord", "ticker", "source_name", "bucket", "bucket_reason"]


@dataclass
class Snapshot:
    """All tables of one run.

    Pairs and their scores are narrow once the watchlist is broadcast; the scored pairs, the
    tally of the routed ones, the stories and the stats, which several tables need, are
    written once and read from there.

    seen_links: (seen_day, link); with it, links of that day are dropped and a link goes only
    to the first entry that it matches. Without it (the default) every entry sees every article.
    failures: (source_key, rows_read, failed), for the snapshot.
    """

    articles: DataFrame
    watchlist: DataFrame
    seen_links: DataFrame | None = None
    day: str | None = None
    failures: DataFrame | None = None

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles.profiles(self.watchlist)

    @cached_property
    def pairs(self) -> DataFrame:
        fresh = spread(self.articles) if self.seen_links is None else seen.unseen(spread(self.articles), self.seen_links, self.day)
        found = matching.candidate_pairs(scoring.prepared(fresh), profiles.needles(self.profiles))
        return found if self.seen_links is None else seen.first_claim(found)

    @cached_property
    def scored_pairs(self) -> DataFrame:
        return scoring.scored(self.pairs)

    @cached_property
    def scored(self) -> DataFrame:
        made = buckets.marked(self.scored_pairs)
        return staged(made.select(*SCORED, *(c for c in DATED if c in made.columns)))

    @cached_property
    def routed(self) -> DataFrame:
        # not written: of a pair only what a table asks for is read, hashed and moved
        return buckets.routed(self.scored)

    @cached_property
    def counted(self) -> DataFrame:
        return self.routed.select(*COUNTED)

    @cached_property
    def tally(self) -> DataFrame:
        return staged(reports.tallied(self.counted))  # a row a source

    @cached_property
    def primary(self) -> DataFrame:
        # accepted rows neither depend on others nor suppress them, so stories skip that join
        return self.scored.where("accepted AND __related IS NULL").drop(*buckets.MARKS)

    @cached_property
    def stories(self) -> DataFrame:
        return staged(clusters.stories(self.primary))

    @cached_property
    def ranked(self) -> DataFrame:
        return clusters.ranked(self.stories)

    @cached_property
    def stats(self) -> DataFrame:
        return staged(reports.ticker_stats(self.watchlist, self.tally, self.stories))  # a row an entry

    @cached_property
    def usage(self) -> DataFrame:
        return reports.source_usage(reports.placed_rows(self.tally, self.ranked))

    @cached_property
    def rows(self) -> DataFrame:
        """The whole snapshot in flat rows."""
        return reports.snapshot_rows(self.watchlist, self.stats, self.routed, self.ranked, self.usage, self.failures)

    def release(self) -> None:
        """Delete what this run has written between its steps; call it once its tables are stored."""
        release(*(t for t in self.__dict__.values() if isinstance(t, DataFrame)))
