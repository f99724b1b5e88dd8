"""Readers of landed files: XML feeds, two JSON shapes, HTML pages, watchlists and snapshots.

Order inside a file is the position there; `file` and `position` give it to later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup, text
from ..functions.dates import published_at
from ..operators.select import cap_per_source, first_per_link, wanted_links
from ..schemas import WATCHLIST
from .dimension import RSS, SELECTORS, STRUCTURED, feed_metadata, with_source
from .writers import latest

ITEM = "title string, link string, description string, summary string, pubDate string, published string, updated string, position long"
GROUPED = "results struct<news: array<struct<newsitem: array<struct<source: string, headline: string, storyurl: string, datetime: string, qmsummary: string>>>>>"
PAGED = "pageIndex int, pageCount int, data struct<articles: array<struct<title: string, releaseurl: string, adate: string, body: string>>>"
ROW = "struct<source_key: string, source_name: string, title: string, link: string, summary: string, coverage_sources: array<string>>"
COUNTS = "map<string, bigint>"
TICKER = (
    "ticker string, company string, "
    f"source_usage struct<raw_matches: {COUNTS}, primary_stories: {COUNTS}, related_context: {COUNTS}, review_candidates: {COUNTS}, rejections: {COUNTS}, primary_story_coverage: {COUNTS}>, "
    f"stories array<{ROW}>, related_context array<{ROW}>, review_candidates array<{ROW}>, rejections array<{ROW}>"
)


def _items(spark: SparkSession, path: str) -> DataFrame:
    """Items of XML feeds below path/source_key=...[/feed_ticker=...], with missing fields as ''.

    An item that is no XML is left out alone (failures.feed_units has it); the parser that reads item by item sees to that.
    """
    schema = T.StructType.fromDDL(ITEM).add("__broken", T.StringType())
    raw = spark.read.format("xml").option("rowTag", "item").option("useLegacyXMLParser", True).option("columnNameOfCorruptRecord", "__broken").schema(schema).load(path)
    raw = raw.where(F.col("__broken").isNull() & F.coalesce(*(F.col(f.name).cast("string") for f in schema.fields[:-1])).isNotNull()).drop("__broken")
    raw = raw.withColumn("source_key", of_path("source_key")).fillna("")
    return raw.withColumn("feed_ticker", F.nullif(of_path("feed_ticker"), F.lit("")))


def of_path(name: str) -> Column:
    """What a row's file has as name=... in its path, '' without it."""
    return F.regexp_extract(F.input_file_name(), f"{name}=([^/]+)", 1)


def read_rss_articles(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Articles of XML feeds: markup stripped from title and summary, both joined as text, with published_at and the feed's metadata. The cap is on items read."""
    items = _items(spark, path)
    if cap:
        items = cap_per_source(items, cap, "position")
    title, summary = text.without_markup(F.col("title")), text.without_markup(text.first_filled(F.col("summary"), F.col("description")))
    return with_source(
        items.select(
            "position",
            "source_key",
            F.lit(RSS).alias("source_group"),
            title.alias("title"),
            summary.alias("summary"),
            "link",
            text.first_filled(F.col("published"), F.col("pubDate"), F.col("updated")).alias("published"),
            F.lit("rss").alias("collection_method"),
            "feed_ticker",
            feed_metadata(F.col("source_key"), F.col("feed_ticker")).alias("metadata"),
        ).withColumns({"text": text.article_text(F.col("title"), F.col("summary")), "published_at": published_at(F.col("published"))}),
        "source_name",
    )


def _headlines(df: DataFrame, method: str, title: Column, link: Column, published: Column, summary: Column) -> DataFrame:
    out = df.select(
        "position",
        "source_key",
        F.lit(STRUCTURED).alias("source_group"),
        text.headline_text(title).alias("title"),
        text.headline_text(summary).alias("summary"),
        text.filled(link).alias("link"),
        text.filled(published).alias("published"),
        F.lit(method).alias("collection_method"),
    )
    out = out.where(text.is_headline(F.col("title"))).withColumn("published_at", published_at(F.col("published")))
    return with_source(out, "source_name")


def read_feed_headlines(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Headlines of XML feeds; the cap is on items read, before implausible titles go."""
    items = _items(spark, path)
    if cap:
        items = cap_per_source(items, cap, "position")
    published = text.first_filled(F.col("published"), F.col("pubDate"), F.col("updated"))
    return _headlines(items, "rss", F.col("title"), F.col("link"), published, text.first_filled(F.col("summary"), F.col("description")))


def read_news_json(spark: SparkSession, path: str, source_key: str, vendor: str | None = None, cap: int | None = None) -> DataFrame:
    """Headlines of grouped news (results.news[].newsitem[]); the cap is on what is kept."""
    raw = spark.read.schema(GROUPED).option("multiLine", True).json(path)
    raw = raw.withColumn("file", F.input_file_name())
    groups = raw.select("file", F.posexplode("results.news").alias("g", "group"))
    items = groups.select("file", "g", F.posexplode("group.newsitem").alias("i", "item"))
    items = items.select(F.struct("file", "g", "i").alias("position"), F.lit(source_key).alias("source_key"), "item.*")
    if vendor:
        items = vendor_filter(items, "source", vendor)
    out = _headlines(items, "json", F.col("headline"), F.col("storyurl"), F.col("datetime"), F.col("qmsummary"))
    return cap_per_source(out, cap, "position") if cap else out


def vendor_filter(df: DataFrame, column: str, vendor: str) -> DataFrame:
    """Rows whose vendor contains a phrase, whatever the case."""
    return df.where(F.contains(F.lower(text.filled(F.col(column))), F.lit(vendor.lower())))


def landed_pages(spark: SparkSession, path: str, source_key: str | None = None) -> DataFrame:
    """(source_key, page, page_count, landing, articles): page files of a paged list, as they landed.

    The source is given or stands in the path (source_key=...), as does the landing (landing=...,
    a number; 0 without it). Files that are no JSON or have no page number give no row (see failures).
    """
    pages = spark.read.schema(PAGED).option("multiLine", True).json(path)
    source = of_path("source_key") if source_key is None else F.lit(source_key)
    landing = F.coalesce(of_path("landing").try_cast("int"), F.lit(0))
    out = pages.select(source.alias("source_key"), F.col("pageIndex").alias("page"), F.coalesce("pageCount", F.lit(1)).alias("page_count"), landing.alias("landing"), "data.articles")
    return out.where("page IS NOT NULL")


def folded_pages(pages: DataFrame) -> DataFrame:
    """Each page once, as it landed last; so a page that comes late or again takes its place in the list."""
    newest = F.max_by(F.struct("page_count", "landing", "articles"), F.struct("landing", F.size("articles")))
    return pages.groupBy("source_key", "page").agg(newest.alias("newest")).select("source_key", "page", "newest.*")


#: Page numbers that are made at a time.
PAGE_BLOCK = 10_000


def missing_pages(pages: DataFrame) -> DataFrame:
    """(source_key, page): pages 0 to the largest page_count of a source that did not land."""
    counts = pages.groupBy("source_key").agg(F.max("page_count").alias("pages")).where("pages > 0")
    blocks = counts.select("source_key", "pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("pages") - 1) / PAGE_BLOCK).cast("int"))).alias("block"))
    last = F.least(F.col("pages"), (F.col("block") + 1) * PAGE_BLOCK) - 1
    wanted = blocks.select("source_key", F.explode(F.sequence(F.col("block") * PAGE_BLOCK, last)).alias("page"))
    return wanted.join(pages.select("source_key", "page").distinct(), ["source_key", "page"], "left_anti")


def read_paged_json(spark: SparkSession, path: str, source_key: str | None = None, cap: int | None = None) -> DataFrame:
    """Headlines of all page files (data.articles[]), in the order of the pages, of each page the last landing; the cap is on what is kept."""
    pages = folded_pages(landed_pages(spark, path, source_key))
    items = pages.select("source_key", "page", F.posexplode("articles").alias("i", "item"))
    items = items.select(F.struct("page", "i").alias("position"), "source_key", "item.*")
    out = _headlines(items, "json", F.col("title"), F.col("releaseurl"), F.col("adate"), F.col("body"))
    return cap_per_source(out, cap, "position") if cap else out


def html_headlines(pages: DataFrame, source_key: str, id_col: str = "page_id", html_col: str = "html", homepage_col: str = "url", cap: int | None = None) -> DataFrame:
    """Headlines of anchors in the order of the source's selectors: plausible titles, wanted links, the first anchor of each link."""
    found = markup.anchors(pages, id_col, html_col, homepage_col, SELECTORS.get(source_key, []))
    found = found.withColumns({"source_key": F.lit(source_key), "position": F.struct("page", "choice", "position")})
    found = found.where(text.is_headline(F.col("title")))
    found = first_per_link(wanted_links(found), "position")
    out = with_source(found.withColumns({"published": F.lit(""), "published_at": F.lit(None).cast("timestamp"), "collection_method": F.lit("html"), "source_group": F.lit(STRUCTURED)}), "source_name").drop("page", "choice")
    return cap_per_source(out, cap, "position") if cap else out


SECTION = "watch_ord int, place bigint, title string, link string, source_key string, source_name string, relevance_score double, event_type string, n bigint, notes array<string>, ticker string, section string"


HEADER = "generated_at string, watchlist_file string, rss_limit int, structured_limit int, include_seen boolean"


def read_sections(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest snapshot that write_sections() wrote, or the one of a version, one row a line."""
    return spark.read.schema(SECTION).json(f"{latest(spark, path, version)}/rows")


def read_header(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The header stored with a snapshot."""
    return spark.read.schema(HEADER).json(f"{latest(spark, path, version)}/header")


def watchlist_entries(raw: DataFrame) -> DataFrame:
    """A checked watchlist from (watch_ord, ticker, company, keywords): a blank ticker is an error, blank keywords go."""
    ticker = F.upper(F.trim(text.filled(F.col("ticker"))))
    keywords = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.trim(text.filled(k))), lambda k: k != "")
    checked = F.when(ticker == "", F.raise_error(F.lit("each watchlist entry must have a ticker"))).otherwise(ticker)
    return raw.select("watch_ord", checked.alias("ticker"), F.trim(text.filled(F.col("company"))).alias("company"), keywords.alias("keywords"))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {ticker, company, keywords}; entries keep their place, repeated tickers stay apart."""
    lines = spark.read.text(path, wholetext=True)
    entry = T.ArrayType(T.StructType(WATCHLIST.fields[1:]))
    top = F.trim(F.col("value")).startswith("[")
    checked = F.when(top, F.from_json("value", entry, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("a watchlist must be a JSON list")))
    raw = lines.select(F.posexplode(checked).alias("watch_ord", "e")).select("watch_ord", "e.*")
    return watchlist_entries(raw)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row a ticker, from snapshots (a list `tickers`) and from files of one ticker alike, in one pass of the files."""
    raw = spark.read.schema(f"{TICKER}, tickers array<struct<{_nested(TICKER)}>>").option("multiLine", True).json(path)
    alone = F.array(F.struct(*(c for c in raw.columns if c != "tickers")))
    return raw.select(F.explode(F.coalesce("tickers", alone)).alias("t")).select("t.*")


def _nested(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)
