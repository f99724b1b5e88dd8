"""The source dimension: one row per feed or news site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SOURCE

RSS, STRUCTURED = "baseline_rss", "structured_news"
# Fixed value: the priority of a source without one of its own.
DEFAULT_PRIORITY = 50
# Key, name, group, feed of one ticker, premium, priority (None: default), links wanted.
SOURCES = [
    ("yahoo_finance", "Yahoo Finance Headlines", RSS, True, False, 90, []),
    ("marketwatch_topstories", "MarketWatch Top Stories", RSS, False, False, 70, []),
    ("marketwatch_marketpulse", "MarketWatch MarketPulse", RSS, False, False, 80, []),
    ("sec_press_releases", "SEC Press Releases", RSS, False, False, 45, []),
    ("prnewswire_all_news", "PR Newswire All News Releases", RSS, False, False, None, []),
    ("prnewswire", "PR Newswire", STRUCTURED, False, False, 85, []),
    ("globenewswire", "GlobeNewswire", STRUCTURED, False, False, 85, []),
    ("accessnewswire", "ACCESS Newswire", STRUCTURED, False, False, 85, ["/news-release/", "/news/"]),
    ("mtnewswires", "MT Newswires", STRUCTURED, False, False, 70, ["/news/"]),
    ("dowjones", "Dow Jones Newswires", STRUCTURED, False, True, None, []),
    ("finviz", "Finviz", STRUCTURED, False, False, 55, []),
]
# Selectors of a source's anchors, in the order they are tried: elements around an anchor (innermost last), then what its href holds.
SELECTORS = {
    "accessnewswire": [([], "/news-release/"), ([], "/news/"), (["section"], "/news-release/"), (["section"], "/news/"), (["article"], "/news-release/"), (["article"], "/news/"), (["h3"], ""), (["h2"], "")],
    "mtnewswires": [([], "/news/")],
    "finviz": [([], "news.ashx"), (["table"], ""), ([], "")],
}
# The address of a source's feed or listing ({ticker}: of a feed of one ticker) and the note its articles carry.
FEEDS = {
    "yahoo_finance": ("https://finance.yahoo.com/rss/headline?s={ticker}", "Ticker-specific Yahoo Finance RSS feed."),
    "marketwatch_topstories": ("https://feeds.content.dowjones.io/public/rss/mw_topstories", "General MarketWatch feed; keyword filtering matters."),
    "marketwatch_marketpulse": ("https://feeds.content.dowjones.io/public/rss/mw_marketpulse", "Short market-moving updates from MarketWatch."),
    "sec_press_releases": ("https://www.sec.gov/news/pressreleases.rss", "Official SEC press release RSS feed."),
    "prnewswire_all_news": ("https://www.prnewswire.com/rss/news-releases-list.rss", "General PR Newswire feed. If the endpoint changes, confirm the latest raw RSS URL from PR Newswire's RSS directory."),
}
#: A source whose links are not held to the wanted ones.
ANY_LINK = ["finviz"]


def sources(spark: SparkSession) -> DataFrame:
    """The dimension, small by nature: joins to it are broadcast."""
    rows = [(*r[:5], DEFAULT_PRIORITY if r[5] is None else r[5], r[6]) for r in SOURCES]
    return spark.createDataFrame(rows, SOURCE)


def feed_metadata(source_key: Column, feed_ticker: Column) -> Column:
    """What an article of a feed carries of it: feed_url, the ticker filled in, and notes; null for a source that is no feed."""
    known = F.create_map(*(x for k, (url, notes) in FEEDS.items() for x in (F.lit(k), F.struct(F.lit(url).alias("url"), F.lit(notes).alias("notes")))))
    feed = F.try_element_at(known, source_key)
    url = F.replace(feed["url"], F.lit("{ticker}"), F.coalesce(F.upper(feed_ticker), F.lit("{ticker}")))
    return F.when(feed.isNotNull(), F.create_map(F.lit("feed_url"), url, F.lit("notes"), feed["notes"]))


def with_source(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns of its source; an unknown source has nulls, and the default priority."""
    dim = F.broadcast(sources(df.sparkSession).select("source_key", *columns))
    out = df.join(dim, "source_key", "left")
    return out.withColumn("priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY))) if "priority" in columns else out


def select_sources(df: DataFrame, keys: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Rows of the chosen sources (all public ones by default). A key that is unknown or premium is an error."""
    known = {r[0]: r for r in SOURCES}
    for key in keys or ():
        if key not in known:
            raise ValueError(f"unknown source: {key}")
        if known[key][4]:
            raise ValueError(f"{key} is a premium source and can't be collected")
    dim = sources(df.sparkSession).where("NOT is_premium")
    dim = dim.where(F.col("source_key").isin(keys)) if keys else dim
    dim = dim.where(F.col("source_group").isin(groups)) if groups else dim
    return df.join(F.broadcast(dim.select("source_key")), "source_key", "left_semi")
