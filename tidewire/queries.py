"""The registered queries: each operator over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup, rules, text
from .functions.dates import published_at
from .operators import buckets, clusters, matching, profiles, reports, scoring, seen, select, sentiment
from .plans.snapshot import Snapshot
from .sources import adapters, failures, readers, writers
from .sources.dimension import RSS, STRUCTURED, select_sources
from .sources.staging import release, shared_folder, staged
from .streaming import claims, poll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEEP_DAYS = 30


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _job(spark: SparkSession, sf_dir: str) -> Snapshot:
    return Snapshot(adapters.articles(spark, sf_dir), adapters.watchlist(spark))


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# Text functions -------------------------------------------------------------------------


@query
def strip_markup(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.without_markup(F.col("html")).alias("clean_text"))


@query
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.headline_text(F.col("html")).alias("clean_text"))


@query
def compose_text(spark, sf_dir):
    return adapters.articles(spark, sf_dir).select("article_id", text.article_text(F.col("title"), F.col("summary")).alias("composed"))


@query
def normalize_phrase(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.phrase(F.col("text")).alias("phrase"))


@query
def keyword_forms(spark, sf_dir):
    return adapters.articles(spark, sf_dir).select("article_id", text.spaced(F.col("summary")).alias("spaced_form"), text.compact(F.col("summary")).alias("compact_form"))


@query
def canonical_links(spark, sf_dir):
    links = adapters.articles(spark, sf_dir).select(F.col("article_id").alias("id"), "link")
    links = links.union(_table(spark, sf_dir, "pages").select(-1 - F.col("page_id"), "url"))
    return links.select("id", text.canonical_link(F.col("link")).alias("canonical_link"))


@query
def title_keys(spark, sf_dir):
    return adapters.articles(spark, sf_dir).select("article_id", text.title_key(F.col("title")).alias("title_key"))


@query
def page_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("page_title"))


@query
def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.page_text(F.col("html")).alias("page_text"))


@query
def resolve_links(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("position", "href"))
    return hrefs.select("page_id", "position", text.resolved_link(F.col("href"), F.col("url")).alias("link"))


@query
def probable_headlines(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    return lines.select("doc_id", "line", text.squeezed(F.col("raw")).alias("title")).where(text.is_headline(F.col("title")))


# The watchlist -----------------------------------------------------------------------------


@query
def watchlist_entries(spark, sf_dir):
    out = readers.watchlist_entries(adapters.part_watchlist(spark, sf_dir))
    return out.select("watch_ord", "ticker", "company", _joined("keywords").alias("keywords"))


@query
def company_tokens(spark, sf_dir):
    return adapters.part_watchlist(spark, sf_dir).select("watch_ord", _joined(profiles.company_tokens(F.col("company"))).alias("tokens"))


@query
def watch_keywords(spark, sf_dir):
    out = profiles.profiles(readers.watchlist_entries(adapters.part_watchlist(spark, sf_dir)))
    return out.select("watch_ord", _joined("watch_keywords").alias("keywords"))


@query
def ticker_profiles(spark, sf_dir):
    out = profiles.profiles(readers.watchlist_entries(adapters.part_watchlist(spark, sf_dir)))
    return out.select("watch_ord", "ticker", *(_joined(f"{k}_terms").alias(f"{k}_terms") for k in ("identity", "specific", "generic")))


# Selection ---------------------------------------------------------------------------------


@query
def select_sources_public(spark, sf_dir):
    return select_sources(adapters.articles(spark, sf_dir), groups=[STRUCTURED]).select("article_id", "source_key")


@query
def cap_per_source(spark, sf_dir):
    return select.cap_per_source(adapters.articles(spark, sf_dir), 10).select("article_id", "source_key")


@query
def vendor_filter(spark, sf_dir):
    return readers.vendor_filter(adapters.articles(spark, sf_dir), "source_name", "newswire").select("article_id", "source_name")


@query
def published_range(spark, sf_dir):
    return select.in_range(_table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1996-12-31").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))


@query
def href_filter(spark, sf_dir):
    rows = adapters.articles(spark, sf_dir).withColumn("link", F.when(F.col("article_id") % 4 == 0, F.regexp_replace("link", "/story/", "/news/")).otherwise(F.col("link")))
    return select.wanted_links(rows).select("article_id", "source_key", "link")


@query
def dedupe_links(spark, sf_dir):
    return select.first_per_link(adapters.articles(spark, sf_dir), "article_id").select("source_key", "link", "article_id")


@query
def combined_articles(spark, sf_dir):
    rows = adapters.articles(spark, sf_dir)
    feeds = rows.where(F.col("source_group") == RSS)
    sites = rows.where(F.col("source_group") == STRUCTURED).drop("text", "feed_ticker")
    return select.combined(feeds, sites).select("article_id", "source_group", "title", "text")


@query
def filter_articles(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.filter_by_text(docs, ["thanedble", "attion", "eriner", "thintion"]).select("doc_id")


# Matching and scoring ----------------------------------------------------------------------


@query
def route_articles(spark, sf_dir):
    return matching.route(adapters.articles(spark, sf_dir), adapters.watchlist(spark))


@query
def candidate_pairs(spark, sf_dir):
    return _job(spark, sf_dir).pairs.select("article_id", "watch_ord")


@query
def keyword_prefilter(spark, sf_dir):
    """Whole documents against the watchlist of all parts, the way of a watchlist too large to test entry by entry."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("article_id"), F.lit("").alias("title"), F.lit("").alias("summary"), "text", F.lit(RSS).alias("source_group"), F.lit(None).cast("string").alias("feed_ticker"))
    watch = adapters.document_watchlist(spark, sf_dir)
    return matching.hit_entries(rows, profiles.needles(profiles.profiles(watch)), entries=0).select("article_id", "watch_ord")


@query
def matched_terms(spark, sf_dir):
    out = _job(spark, sf_dir).scored_pairs
    return out.select("article_id", "watch_ord", *(_joined(f"matched_{k}").alias(k) for k in rules.POINTS))


@query
def event_types(spark, sf_dir):
    return rules.with_event(adapters.articles(spark, sf_dir)).select("article_id", "event_type", F.col("event_weight").alias("weight"))


@query
def roundup_titles(spark, sf_dir):
    return adapters.articles(spark, sf_dir).where(rules.is_roundup(F.col("title"))).select("article_id", "title")


@query
def context_titles(spark, sf_dir):
    return adapters.articles(spark, sf_dir).where(rules.is_context(F.col("title"))).select("article_id", "title")


@query
def relevance_scores(spark, sf_dir):
    return _job(spark, sf_dir).scored_pairs.select("article_id", "watch_ord", "relevance_score")


@query
def rejection_reasons(spark, sf_dir):
    return _job(spark, sf_dir).scored_pairs.select("article_id", "watch_ord", "accepted", _joined("rejection_reasons").alias("reasons"))


# Buckets, clusters, reports ----------------------------------------------------------------


@query
def bucket_rows(spark, sf_dir):
    return _job(spark, sf_dir).routed.select("article_id", "watch_ord", "bucket", "bucket_reason")


@query
def suppress_by_key(spark, sf_dir):
    return _job(spark, sf_dir).routed.where("bucket = 'suppressed'").select("article_id", "watch_ord", "canonical_link", "title_key", "title")


@query
def related_context(spark, sf_dir):
    return _job(spark, sf_dir).routed.where("bucket = 'related'").select("article_id", "watch_ord", "bucket_reason", "relevance_score")


@query
def cluster_keys(spark, sf_dir):
    return clusters.keyed(_job(spark, sf_dir).primary).select("article_id", "watch_ord", "cluster_key")


def _flat(stories: DataFrame) -> DataFrame:
    lists = {c: _joined(c) for c in ("coverage_sources", "coverage_source_keys", "duplicate_links", "merged_titles")}
    return stories.withColumns(lists).withColumn("coverage_count", F.col("coverage_count").cast("bigint")).drop("event_weight", "summary", "published", "first_ord")


@query
def story_clusters(spark, sf_dir):
    return _flat(_job(spark, sf_dir).stories)


@query
def story_members(spark, sf_dir):
    """All rows of all stories."""
    job = _job(spark, sf_dir)
    return clusters.members(job.primary, job.stories)


@query
def story_coverage(spark, sf_dir):
    """How many rows, sources, links and titles a story has, from its members."""
    job = _job(spark, sf_dir)
    return clusters.member_counts(clusters.members(job.primary, job.stories))


@query
def top_stories(spark, sf_dir):
    """The flagship: all stories of all entries, ranked."""
    return _flat(_job(spark, sf_dir).ranked)


@query
def ticker_stats(spark, sf_dir):
    return _job(spark, sf_dir).stats


@query
def watchlist_summary(spark, sf_dir):
    return reports.watchlist_summary(_job(spark, sf_dir).stats)


@query
def source_usage(spark, sf_dir):
    return _job(spark, sf_dir).usage.drop("first_place")


@query
def source_usage_ranked(spark, sf_dir):
    return reports.usage_ranked(_job(spark, sf_dir).usage)


@query
def source_coverage(spark, sf_dir):
    return _job(spark, sf_dir).usage.where("bucket = 'coverage'").select("watch_ord", "ticker", "source_name", "n")


@query
def watchlist_snapshot(spark, sf_dir):
    return _job(spark, sf_dir).rows.withColumn("notes", _joined("notes"))


# Seen links --------------------------------------------------------------------------------


@query
def unseen_links(spark, sf_dir):
    """Articles whose link no site had the day before."""
    rows = adapters.articles(spark, sf_dir).withColumn("seen_day", F.to_date("published"))
    links = rows.where(F.col("source_group") == STRUCTURED).select(F.date_add("seen_day", 1).alias("seen_day"), "link")
    return seen.unseen(rows, links).select("article_id", "link")


@query
def first_claim(spark, sf_dir):
    return seen.first_claim(_job(spark, sf_dir).pairs).select("article_id", "watch_ord", "link")


# Sentiment ---------------------------------------------------------------------------------


@query
def score_sentiment(spark, sf_dir):
    return sentiment.scored(adapters.articles(spark, sf_dir).where(F.col("source_group") == RSS))


@query
def overall_sentiment(spark, sf_dir):
    pairs = _job(spark, sf_dir).pairs.where(F.col("source_group") == RSS).select("article_id", "watch_ord", "ticker")
    scores = sentiment.scored(adapters.articles(spark, sf_dir).where(F.col("source_group") == RSS))
    out = sentiment.overall(pairs.join(scores, "article_id"), "watch_ord", "ticker")
    return out.select("watch_ord", "ticker", "n_scored", text.rounded(F.col("mean_score")).alias("mean_score"), "overall")


@query
def fitted_quality(spark, sf_dir):
    """A classifier fitted on the labelled documents of one split, applied to all documents, with probabilities set by a second split."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    known = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    models = sentiment.fit_calibrated(docs.join(known, "doc_id"), "doc_id")
    return sentiment.scored_calibrated(models, docs, "doc_id")


# Files: written from the tables to a shared folder, then read --------------------------------


def _landed_feeds(spark: SparkSession, sf_dir: str) -> str:
    at = shared_folder(spark)
    rows = adapters.articles(spark, sf_dir).where(F.col("source_group") == RSS)
    items = rows.select("source_key", F.concat(F.lit("<b>"), "title", F.lit("</b> &amp; more")).alias("title"), "link", F.col("summary").alias("description"), F.col("published").alias("pubDate"), F.col("article_id").alias("position"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "rss").partitionBy("source_key").save(at)
    return at


@query
def read_rss_articles(spark, sf_dir):
    return readers.read_rss_articles(spark, _landed_feeds(spark, sf_dir)).select(F.col("position").alias("article_id"), "source_key", "source_name", "title", "summary", "link", "published", "text")


@query
def read_feed_headlines(spark, sf_dir):
    return readers.read_feed_headlines(spark, _landed_feeds(spark, sf_dir)).select(F.col("position").alias("article_id"), "source_key", "title", "summary", "link", "published")


@query
def read_news_json(spark, sf_dir):
    at = shared_folder(spark)
    rows = adapters.articles(spark, sf_dir).where(F.col("source_group") == STRUCTURED)
    item = F.struct(F.col("source_name").alias("source"), F.col("title").alias("headline"), F.col("link").alias("storyurl"), F.col("published").alias("datetime"), F.col("summary").alias("qmsummary"))
    groups = rows.groupBy(F.floor(F.col("article_id") / 1000).alias("g")).agg(F.array_sort(F.collect_list(item)).alias("newsitem"))
    groups.select(F.struct(F.array(F.struct("newsitem")).alias("news")).alias("results")).write.option("maxRecordsPerFile", 1).json(at)
    return readers.read_news_json(spark, at, "accessnewswire", "newswire").select("source_key", "title", "summary", "link", "published")


@query
def read_paged_json(spark, sf_dir):
    at = shared_folder(spark)
    rows = adapters.articles(spark, sf_dir).where(F.col("source_key") == "accessnewswire")
    item = F.struct("title", F.col("link").alias("releaseurl"), F.col("published").alias("adate"), F.col("summary").alias("body"))
    pages = rows.groupBy(F.floor(F.col("article_id") / 1000).cast("int").alias("pageIndex")).agg(F.struct(F.array_sort(F.collect_list(item)).alias("articles")).alias("data"))
    pages.write.option("maxRecordsPerFile", 1).json(at)
    return readers.read_paged_json(spark, at, "accessnewswire").select("source_key", "title", "summary", "link", "published")


@query
def html_anchors(spark, sf_dir):
    """All anchors of the pages, before implausible titles go."""
    found = markup.anchors(_table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return found.select(F.col("page").alias("page_id"), "position", "link", "title", "summary")


@query
def html_headlines(spark, sf_dir):
    """Headlines of list pages made of the articles; each page is a landed file."""
    at = shared_folder(spark)
    adapters.pages_of(adapters.articles(spark, sf_dir)).write.parquet(at)
    return readers.html_headlines(spark.read.parquet(at), "finviz").select("source_key", "title", "link", "summary")


@query
def published_dates(spark, sf_dir):
    """The moment of every article, from all forms of dates; a blank one has none."""
    rows = adapters.landed_dates(adapters.articles(spark, sf_dir)).select("article_id", published_at(F.col("published")).alias("at"))
    return rows.select("article_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query
def feed_metadata(spark, sf_dir):
    """What the articles of feeds carry of their feed; a feed of one ticker lies in a folder of that ticker."""
    at = shared_folder(spark)
    rows = adapters.articles(spark, sf_dir).where((F.col("source_group") == RSS) & (F.col("feed_ticker").isNull() | (F.col("source_key") == "yahoo_finance")))
    items = rows.select("source_key", F.coalesce("feed_ticker", F.lit("-")).alias("feed_ticker"), "title", "link", F.col("article_id").alias("position"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "rss").partitionBy("source_key", "feed_ticker").save(at)
    read = readers.read_rss_articles(spark, at)
    return read.select(F.col("position").alias("article_id"), F.nullif("feed_ticker", F.lit("-")).alias("feed_ticker"), F.col("metadata")["feed_url"].alias("feed_url"), F.col("metadata")["notes"].alias("notes"))


def _landed_broken(spark: SparkSession, sf_dir: str) -> str:
    """Feeds, grouped news, page files and HTML pages of the articles, some of each broken, below kind/source_key=..."""
    at = shared_folder(spark)
    rows, k = adapters.articles(spark, sf_dir), F.col("article_id")
    item = F.concat(F.lit("<item><title>"), "title", F.when(k % 9 == 0, "</titel>").otherwise("</title>"), F.lit("</item>"))
    rows.where(F.col("source_group") == RSS).select("source_key", item.alias("value")).write.partitionBy("source_key").text(f"{at}/xml")

    def files(kind: str, key: str, made: Column) -> None:
        some = rows.where(F.col("source_key") == key).groupBy("source_key", F.floor(k / 1000).alias("g")).agg(F.array_sort(F.collect_list(F.struct("article_id", "title", "link"))).alias("rows"))
        some.select("source_key", made.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("source_key").text(f"{at}/{kind}")

    grouped = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform("rows", lambda r: F.struct(r["title"].alias("headline"), r["link"].alias("storyurl"))).alias("newsitem"))).alias("news")).alias("results")))
    files("grouped", "globenewswire", F.when(F.col("g") % 4 == 1, F.substring(grouped, 1, 40)).otherwise(grouped))
    paged = F.to_json(F.struct(F.when(F.col("g") % 5 != 2, F.col("g").cast("int")).alias("pageIndex"), F.struct(F.transform("rows", lambda r: F.struct(r["title"].alias("title"))).alias("articles")).alias("data")))
    files("paged", "accessnewswire", F.when(F.col("g") % 4 == 3, F.concat(F.lit("<html>"), paged)).otherwise(paged))
    anchors = F.array_join(F.transform("rows", lambda r: F.concat(F.lit('<a href="'), r["link"], F.lit('">'), r["title"], F.lit("</a>"))), "")
    files("html", "finviz", F.when(F.col("g") % 6 == 4, F.lit("<html>no news</html>")).otherwise(F.concat(F.lit("<html>"), anchors, F.lit("</html>"))))
    return at


@query
def source_failures(spark, sf_dir):
    at = _landed_broken(spark, sf_dir)
    return failures.counted(failures.feed_units(spark, f"{at}/xml"), failures.grouped_units(spark, f"{at}/grouped"), failures.paged_units(spark, f"{at}/paged"), failures.page_units(spark, f"{at}/html"))


@query
def quarantined(spark, sf_dir):
    """The failed units, put aside by source and read again."""
    at, out = _landed_broken(spark, sf_dir), shared_folder(spark)
    for units in (failures.feed_units(spark, f"{at}/xml"), failures.grouped_units(spark, f"{at}/grouped")):
        failures.quarantine(units, out)
    return spark.read.json(out).groupBy("source_key", "kind", "error").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.regexp_replace("raw", r"\s+$", ""))).cast("bigint").alias("longest"))


def _landed_pages(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Page files of two sources in two landings: one in five pages is missing at first, half of these come late, and page 0 comes again."""
    at = shared_folder(spark)
    rows = adapters.articles(spark, sf_dir).where(F.col("source_key").isin("accessnewswire", "prnewswire"))
    page = F.floor(F.col("article_id") / 500).cast("int").alias("pageIndex")
    item = F.struct(F.col("article_id").alias("order"), "title", F.col("link").alias("releaseurl"), F.col("published").alias("adate"), F.col("summary").alias("body"))
    pages = rows.groupBy("source_key", page).agg(F.struct(F.array_sort(F.collect_list(item)).alias("articles")).alias("data"))
    pages = pages.join(F.broadcast(pages.groupBy("source_key").agg((F.max("pageIndex") + 1).alias("pageCount"))), "source_key")
    first, late = pages.where("pageIndex % 5 <> 3"), pages.where("pageIndex % 10 = 3 OR pageIndex = 0")
    again = F.struct(F.transform("data.articles", lambda a: a.withField("title", F.concat(a["title"], F.lit(" (corrected)")))).alias("articles"))
    for landing, some in ((1, first), (2, late.withColumn("data", F.when(F.col("pageIndex") == 0, again).otherwise(F.col("data"))))):
        some.write.option("maxRecordsPerFile", 1).partitionBy("source_key").json(f"{at}/landing={landing}")
    return f"{at}/landing=1", at


@query
def missing_pages(spark, sf_dir):
    """Pages that are missing after the first landing and after both."""
    first, both = _landed_pages(spark, sf_dir)
    gaps = [readers.missing_pages(readers.folded_pages(readers.landed_pages(spark, at))).withColumn("landings", F.lit(n)) for n, at in ((1, first), (2, both))]
    return gaps[0].union(gaps[1])


@query
def read_late_pages(spark, sf_dir):
    """Headlines of two landings of pages: of a page that landed twice the later one's."""
    _, both = _landed_pages(spark, sf_dir)
    return readers.read_paged_json(spark, both).select("source_key", "title", "summary", "link", "published")


def _landed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written in sections and read back; one entry has no stored usage."""
    at = shared_folder(spark)
    rows = _job(spark, sf_dir).rows
    head = reports.header("2024-01-01T00:00:00Z", "watchlist.json", 0, 0, True, spark)
    writers.write_sections(rows.where("section <> 'source_usage' OR ticker <> 'PANW'"), at, head)
    return readers.read_sections(spark, at).withColumn("generated_at", F.lit(readers.read_header(spark, at).first()["generated_at"]))


@query
def read_sections(spark, sf_dir):
    rows = _landed_snapshot(spark, sf_dir)
    size = lambda s: F.count_if(F.col("section") == s).alias(f"n_{s}")
    return rows.groupBy("ticker", "generated_at").agg(*map(size, reports.SECTIONS.values()))


@query
def usage_from_snapshot(spark, sf_dir):
    return reports.usage_of_sections(_landed_snapshot(spark, sf_dir))


def _landed_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots in the nested form, read back: a file for an entry and ten thousand articles, every other one as a list of tickers."""
    at = shared_folder(spark)
    job = _job(spark, sf_dir)
    columns = ["source_key", "source_name", "title", "link", "summary"]
    none = F.array().cast("array<string>").alias("coverage_sources")
    story = job.stories.select("ticker", "article_id", F.lit("stories").alias("section"), F.struct(*columns, "coverage_sources").alias("row"))
    named = F.coalesce(*(F.when(F.col("bucket") == b, s) for b, s in reports.SECTIONS.items()))
    other = job.routed.where(F.col("bucket").isin("related", "review", "rejected")).select("ticker", "article_id", named.alias("section"), F.struct(*columns, none).alias("row"))
    of = lambda s: F.collect_list(F.when(F.col("section") == s, F.col("row"))).alias(s)
    files = story.union(other).groupBy("ticker", F.floor(F.col("article_id") / 10_000).alias("g")).agg(*map(of, reports.SECTIONS.values()))
    one = F.struct("ticker", *reports.SECTIONS.values())
    text = F.when(F.col("g") % 2 == 0, F.to_json(one)).otherwise(F.to_json(F.struct(F.array(one).alias("tickers"))))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return readers.read_snapshot(spark, at)


@query
def read_snapshot(spark, sf_dir):
    size = lambda s: F.sum(F.coalesce(F.size(s), F.lit(0))).alias(f"n_{s}")
    return _landed_nested(spark, sf_dir).groupBy("ticker").agg(*map(size, reports.SECTIONS.values()))


@query
def usage_from_nested(spark, sf_dir):
    """Source usage of nested snapshots, recounted from their rows; what lies in several files is added up."""
    return reports.usage_of_snapshot(_landed_nested(spark, sf_dir)).groupBy("ticker", "bucket", "source_name").agg(F.sum("n").alias("n"))


@query
def write_snapshot(spark, sf_dir):
    at, stats = shared_folder(spark), _job(spark, sf_dir).stats
    for _ in range(2):
        writers.write_latest(stats, at)
    return writers.read_latest(spark, at)


@query
def snapshot_versions(spark, sf_dir):
    """Both versions of a snapshot that was replaced: the first has the entries up to 2 only."""
    at = shared_folder(spark)
    stats = _job(spark, sf_dir).stats.select("watch_ord", "ticker", "raw_rows", "story_count")
    kept = [writers.write_latest(rows, at) for rows in (stats.where("watch_ord <= 2"), stats)]
    return reduce(DataFrame.union, (writers.read_latest(spark, at, version=v).withColumn("version", F.lit(v)) for v in kept))


@query
def write_history(spark, sf_dir):
    at = shared_folder(spark)
    stats = _job(spark, sf_dir).stats
    for t in ("2024-01-01T00-00-00Z", "2024-01-01T00-02-00Z", "2024-01-01T00-02-00Z"):
        writers.write_history(stats, at, t)
    return spark.read.parquet(at).withColumn("generated_at", F.col("generated_at").cast("string"))


@query
def history_retention(spark, sf_dir):
    days = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return writers.retained(days, "day", KEEP_DAYS).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


# Streams -----------------------------------------------------------------------------------


@query
def stream_first_seen(spark, sf_dir):
    """First link of each day of a stream of event files, run to its end."""
    at, out = shared_folder(spark), shared_folder(spark)
    events = _table(spark, sf_dir, "events")
    events.write.parquet(at)  # the stream reads a folder
    stream = spark.readStream.schema(events.schema).parquet(at)
    links = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("link"))
    run = poll.first_seen(links, "2 days").select("seen_day", "link").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("seen_day date, link string").parquet(out).select(F.date_format("seen_day", "yyyy-MM-dd").alias("seen_day"), "link")


def _landing(spark: SparkSession, rows: DataFrame, parts: list[Column], at: str, start: Callable[[DataFrame], None]) -> None:
    """Rows that land part by part in a folder; start() is given the stream after each and runs it to its end."""
    for part in parts:
        rows.where(part).write.mode("append").parquet(at)
        start(spark.readStream.schema(rows.schema).parquet(at))


@query
def stream_snapshot(spark, sf_dir):
    """Stories of a stream of article files that land in two halves, a batch each, dated in all forms; links claimed by the first are left out of the second.

    An article without a date has the day of its batch, the first two of 2030. Links of days before the last are dropped.
    """
    at, out = shared_folder(spark), shared_folder(spark)
    rows = adapters.landed_dates(adapters.articles(spark, sf_dir))
    job = poll.refresh(adapters.watchlist(spark), out, include_seen=False, seen_days=1, today=lambda n: f"2030-01-{n + 1:02d}")

    def start(stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(job).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    _landing(spark, rows, [F.col("article_id") % 2 == half for half in (0, 1)], at, start)
    history = spark.read.parquet(f"{out}/history")
    return history.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_stories"), F.sum("coverage_count").alias("n_rows"))


#: The days in which articles land, in this order, each in two parts.
PERIODS = ["1900-01-01", "1998-04-01", "2100-01-01"]


@query
def stream_first_claim(spark, sf_dir):
    """Pairs of articles that land in four parts, each link and day claimed by the first entry of the first part, from the stream's own state.

    Days older than the state's delay lose their claims by timer; the parts are in the order of the days.
    """
    at, out = shared_folder(spark), shared_folder(spark)
    rows = adapters.articles(spark, sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        both = staged(batch)  # the state is advanced once
        claims.settled(both).select("article_id", "watch_ord", "link").write.mode("overwrite").parquet(f"{out}/batch={number}")
        release(both)

    def start(stream: DataFrame) -> None:
        pairs = claims.claimed_pairs(stream, adapters.watchlist(spark), "1300 days")
        pairs = pairs.select("article_id", "watch_ord", "source_group", "link", "seen_day", "claim")  # a batch is made whole, unlike a table
        with claims.rocksdb(spark):
            pairs.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    parts = [F.col("published").between(a, b) & (F.col("published") < b) & (F.col("article_id") % 2 == half) for a, b in zip(PERIODS, PERIODS[1:]) for half in (0, 1)]
    _landing(spark, rows, parts, at, start)
    return spark.read.schema("article_id long, watch_ord int, link string").parquet(out).select("article_id", "watch_ord", "link")


@query
def stream_usage(spark, sf_dir):
    """Source usage of articles that land in two halves, folded batch by batch in the state of a stream."""
    at, out = shared_folder(spark), shared_folder(spark)
    rows = adapters.articles(spark, sf_dir)
    job = poll.refresh(adapters.watchlist(spark), out, include_seen=True)

    def start(stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(job).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        poll.fold_usage(spark, f"{out}/usage", f"{out}/total")

    _landing(spark, rows, [F.col("article_id") % 2 == half for half in (0, 1)], at, start)
    return writers.read_latest(spark, f"{out}/total/latest").select("watch_ord", "ticker", "bucket", "source_name", "n")
