"""Articles and watchlists derived from business tables, for jobs that have no landed feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_text
from ..schemas import WATCHLIST
from .dimension import RSS, SOURCES, STRUCTURED, with_source

KEYS = "|".join(s[0] for s in SOURCES if not s[4])
SUBJECTS = "Apple|AAPL|Nvidia|Tesla|Microsoft|Amazon|Palo Alto Networks|iPhone|CUDA|Robotaxi|Azure|Andy Jassy|Market watchers|Regional banks|Chip makers|Regulators"
PHRASES = (
    "names new CEO|wins analyst upgrade|posts record earnings|faces export controls|launches copilot for mac|stock extends winning streak|vs rivals|top stories|"
    "opens new office|shares rise on ai demand|in focus|magnificent seven update|raises prices|3 stocks to buy|partners with OpenAI|settles case|expands gpu cluster"
)
TICKERS = "AAPL|NVDA|TSLA|MSFT|AMZN|PANW"
# The watchlist that the articles are made for, with one entry more.
WATCHED = [
    (0, "AAPL", "Apple", ["iphone", "ipad", "mac"]),
    (1, "NVDA", "Nvidia", ["gpu", "ai", "cuda", "jensen"]),
    (2, "TSLA", "Tesla", ["musk", "ev", "robotaxi"]),
    (3, "MSFT", "Microsoft", ["azure", "copilot", "openai"]),
    (4, "AMZN", "Amazon", ["aws", "prime", "andy jassy"]),
    (5, "PANW", "Palo Alto Networks Inc.", ["firewall", "palo alto networks"]),
]
FORMS = "Inc.|Corp|Holdings Ltd.|Group|"


def _item(listed: str, i: Column) -> Column:
    return F.split_part(F.lit(listed), F.lit("|"), i.cast("int"))


def watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WATCHED, WATCHLIST)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article an order: its key picks source and title, its customer the summary and the link."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    source = 1 + k % 10
    title = F.concat(_item(SUBJECTS, 1 + F.floor(k / 10) % 16), F.lit(" "), _item(PHRASES, 1 + F.floor(k / 160) % 17), F.when(c % 4 == 0, "").otherwise(F.concat(F.lit(" note "), (c % 97).cast("string"))))
    summary = F.concat(_item(SUBJECTS, 1 + c % 16), F.lit(" "), _item(PHRASES, 1 + F.floor(c / 16) % 17), F.lit(", said "), _item(SUBJECTS, 1 + F.floor(c / 7) % 16), F.lit(" on "), day)
    link = F.concat(F.lit("https://News.example.com/story/"), (c % 701).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("/?id="), k.cast("string"))).otherwise(""))
    out = orders.select(
        k.cast("bigint").alias("article_id"),
        F.when(source <= 5, RSS).otherwise(STRUCTURED).alias("source_group"),
        _item(KEYS, source).alias("source_key"),
        title.alias("title"),
        F.when(c % 5 == 0, "").otherwise(summary).alias("summary"),
        F.when(c % 53 == 0, "").otherwise(link).alias("link"),
        day.alias("published"),
        F.when(source <= 5, "rss").otherwise("json").alias("collection_method"),
        F.when(source == 1, _item(TICKERS, 1 + c % 6)).alias("feed_ticker"),
    )
    out = out.withColumn("text", F.when(F.col("source_group") == RSS, article_text(F.col("title"), F.col("summary"))).otherwise(""))
    return with_source(out, "source_name")


#: Forms of dates in which articles land, by the remainder of their number; the third is of the next day in UTC, the last is blank.
DATE_FORMS = ["yyyy-MM-dd", "EEE, dd MMM yyyy '10:00:00 GMT'", "EEE, d MMM yyyy '22:30 -0500'", "yyyy-MM-dd'T23:59:59.250+01:00'", "MMMM d, yyyy '4:05 PM EST'", "dd MMM yy '00:15:00 UT'", ""]


def landed_dates(articles: DataFrame) -> DataFrame:
    """articles with their dates in the forms that feeds, JSON and pages give."""
    day, form = F.to_date("published"), F.col("article_id") % len(DATE_FORMS)
    cases = F.lit("")
    for i, f in enumerate(DATE_FORMS[:-1]):
        cases = F.when(form == i, F.date_format(day, f)).otherwise(cases)
    return articles.withColumn("published", cases)


def pages_of(articles: DataFrame, each: int = 100) -> DataFrame:
    """(page_id, url, html): lists of articles as a news site shows them, an anchor an article with its summary beside it."""
    plain = F.concat(F.lit("/story/"), (F.length("summary") * 7 + F.length("title")).cast("string"))
    href = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("/news.ashx?v="), (F.col("article_id") % 501).cast("string"))).otherwise(plain)
    row = F.concat(F.lit("<tr><td><a class='t' href='"), href, F.lit("'>"), "title", F.lit("</a>  <i>"), "summary", F.lit("</i></td></tr>\n"))
    some = articles.where("article_id % 50 <> 7").groupBy(F.floor(F.col("article_id") / each).alias("page_id"))  # at most `each` rows
    rows = F.array_sort(F.collect_list(F.struct("article_id", row.alias("row"))))
    html = F.concat(F.lit("<html><head><title>News &amp; more</title></head><body><a href='/'>Home</a><table>"), F.array_join(F.transform(rows, lambda r: r["row"]), ""), F.lit("</table></body></html>"))
    return some.agg(html.alias("html")).select("page_id", F.lit("https://finviz.com/").alias("url"), "html")


def document_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist of words that documents hold: an entry a part, its keywords the first and the third word of a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", " ").alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    some = docs.where(F.length(word(0)).between(6, 40) & F.length(word(2)).between(6, 40))
    return some.select(F.col("doc_id").cast("int").alias("watch_ord"), F.concat(F.lit("Ticker no "), F.col("doc_id").cast("string")).alias("ticker"), word(0).alias("company"), F.array(word(2)).alias("keywords"))


def part_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist with an entry a part, unchecked: tickers in lower case, blank and repeated keywords."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    company = F.concat("p_name", F.lit(" "), _item(FORMS, 1 + k % 5))
    words = F.array("p_brand", F.lit("Chip"), F.lit("  "), F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type", F.lit("market"))
    return part.select(k.cast("int").alias("watch_ord"), F.concat(F.lit(" t"), k.cast("string")).alias("ticker"), company.alias("company"), F.when(k % 7 != 0, words).alias("keywords"))
