"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import reports
from tidewire.schemas import ARTICLE, WATCHLIST
from tidewire.sources import adapters, failures, readers, writers
from tidewire.sources.dimension import RSS
from tidewire.streaming import claims, poll

LONG = "A headline that is long enough"


def put(folder, name, text):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text, encoding="utf-8")


FEED = f"""<?xml version="1.0"?><rss><channel><title>x</title>
<item><title><![CDATA[<b>{LONG}</b>]]></title><link>http://x/1</link><description>&lt;p&gt;One &amp;amp; two&lt;/p&gt;</description><pubDate>Mon</pubDate></item>
<item><title>Home</title><link>http://x/2</link><summary>s</summary><updated>Tue</updated></item>
</channel></rss>"""


def test_feeds(spark, tmp_path):
    put(tmp_path, "source_key=sec_press_releases/a.xml", FEED)
    rows = readers.read_rss_articles(spark, str(tmp_path)).orderBy("link").collect()
    assert [(r["title"], r["summary"], r["published"]) for r in rows] == [(LONG, "One & two", "Mon"), ("Home", "s", "Tue")]
    assert rows[0]["metadata"]["feed_url"] == "https://www.sec.gov/news/pressreleases.rss" and rows[0]["published_at"] is None
    assert rows[0]["text"] == f"{LONG}. One & two" and rows[0]["source_name"] == "SEC Press Releases" and rows[0]["source_group"] == RSS
    heads = readers.read_feed_headlines(spark, str(tmp_path)).collect()
    # the file's references are the parser's, those of the text are resolved once
    assert [(r["title"], r["summary"]) for r in heads] == [(f"<b>{LONG}</b>", "<p>One & two</p>")]


def test_grouped_and_paged_json(spark, tmp_path):
    item = lambda s, h: {"source": s, "headline": h, "storyurl": "u", "datetime": "d", "qmsummary": None}
    put(tmp_path, "g/a.json", json.dumps({"results": {"news": [{"newsitem": [item("ACCESS Newswire", LONG), item("Other", LONG + " b"), item("Access", "short")]}, {"newsitem": [item("accessnewswire", LONG + " c")]}, {}]}}, indent=1))
    put(tmp_path, "g/b.json", json.dumps({"results": {}}))
    got = readers.read_news_json(spark, str(tmp_path / "g"), "accessnewswire", "newswire").collect()
    assert sorted(r["title"] for r in got) == [LONG, LONG + " c"] and got[0]["summary"] == "" and got[0]["collection_method"] == "json"
    assert readers.read_news_json(spark, str(tmp_path / "g"), "accessnewswire", cap=2).count() == 2
    for page in (1, 2):
        put(tmp_path, f"p/{page}.json", json.dumps({"pageIndex": page, "pageCount": 2, "data": {"articles": [{"title": f"{LONG} {page} {i}", "releaseurl": f"u{page}{i}", "adate": "d", "body": "b"} for i in range(2)]}}))
    rows = readers.read_paged_json(spark, str(tmp_path / "p"), "accessnewswire").orderBy("position").collect()
    assert [r["link"] for r in rows] == ["u10", "u11", "u20", "u21"]
    assert [r["link"] for r in readers.read_paged_json(spark, str(tmp_path / "p"), "accessnewswire", cap=3).orderBy("position").collect()] == ["u10", "u11", "u20"]


def test_html(spark):
    page = f"""<html><body><div>Before <a href="/news/1">{LONG} <b>one</b></a> after</div><a href="/news/1">{LONG} again</a>
<p><a href="/blog/2">{LONG} two</a></p><a href="">{LONG} none</a><a href="/news/3">short</a><br><a href="https://o.com/news/4">{LONG} &amp; four</a></body></html>"""
    df = spark.createDataFrame([(1, page, "https://site.com/x"), (2, None, "https://site.com/x")], "page_id long, html string, url string")
    rows = {r["link"]: r for r in readers.html_headlines(df, "mtnewswires").collect()}
    assert set(rows) == {"https://site.com/news/1", "https://o.com/news/4"}
    assert rows["https://site.com/news/1"]["title"] == f"{LONG} one" and rows["https://site.com/news/1"]["summary"] == f"Before {LONG} one after"
    assert rows["https://o.com/news/4"]["title"] == f"{LONG} & four"
    order = {r["link"]: r["title"] for r in readers.html_headlines(spark.createDataFrame([(1, f"<a href='/news/1'>{LONG} late</a><section><a href='/news-release/9'>{LONG} first</a></section><h3><a href='/x'>{LONG} other</a></h3><a href='/news/1'>{LONG} again</a>", "https://s.com")], df.schema), "accessnewswire", cap=1).collect()}
    assert order == {"https://s.com/news-release/9": f"{LONG} first"}  # the source's first selector comes before the page's first anchor
    assert readers.html_headlines(df, "finviz").count() == 3 and readers.html_headlines(df, "finviz", cap=1).count() == 1


def test_watchlist_file(spark, tmp_path):
    put(tmp_path, "w.json", json.dumps([{"ticker": " aapl ", "company": "Apple", "keywords": ["mac", " ", None]}, {"ticker": "AAPL"}, {"ticker": "x", "keywords": None}], indent=2))
    rows = readers.read_watchlist(spark, str(tmp_path / "w.json")).orderBy("watch_ord").collect()
    assert [tuple(r) for r in rows] == [(0, "AAPL", "Apple", ["mac"]), (1, "AAPL", "", []), (2, "X", "", [])]
    put(tmp_path, "bad.json", json.dumps({"ticker": "a"}))
    put(tmp_path, "blank.json", json.dumps([{"ticker": " "}]))
    for name in ("bad.json", "blank.json"):
        with pytest.raises(Exception, match="watchlist"):
            readers.read_watchlist(spark, str(tmp_path / name)).collect()


def test_snapshots_read_back(spark, tmp_path):
    row = lambda s: {"source_key": s, "source_name": s, "title": "t", "link": "l"}
    one = {"ticker": "A", "source_usage": {"raw_matches": {"s1": 3}, "primary_stories": {"s1": 1}}, "stories": [{**row("s1"), "coverage_sources": ["s1", "s2"]}], "related_context": [row("s3"), row("s3")]}
    put(tmp_path, "a.json", json.dumps({"generated_at": "x", "tickers": [one, {"ticker": "B", "stories": []}]}))
    put(tmp_path, "b.json", json.dumps({"ticker": "C", "rejections": [row("s4"), row("")]}))
    tickers = readers.read_snapshot(spark, str(tmp_path))
    assert {r["ticker"] for r in tickers.collect()} == {"A", "B", "C"}
    got = {tuple(r) for r in reports.usage_of_snapshot(tickers).collect()}
    assert got == {("A", "raw_matches", "s1", 3), ("A", "primary_stories", "s1", 1), ("A", "related_context", "s3", 2), ("A", "primary_story_coverage", "s1", 1), ("A", "primary_story_coverage", "s2", 1), ("C", "rejections", "s4", 1)}


def test_failures_of_every_kind(spark, tmp_path):
    put(tmp_path, "xml/source_key=a/1.xml", "<rss><item><title>One</title></item><item><title>Two</item><item><title>Three</title></item><item></item></rss>")
    put(tmp_path, "xml/source_key=b/b c+d.xml", "no feed <item><title>cut")
    (tmp_path / "xml/source_key=b/3.xml.gz").write_bytes(b"\x1f\x8b\x08\x00broken")
    news = {"results": {"news": [{"newsitem": [{"headline": "h"}, {"headline": "i"}]}, {}]}}
    for name, content in (("1", json.dumps(news, indent=1)), ("2", '{"results": {"news": ['), ("3", "{}")):
        put(tmp_path, f"grouped/source_key=g/{name}.json", content)
    for name, content in (("1", json.dumps({"pageIndex": 0, "pageCount": 2, "data": {"articles": [{"title": "a"}]}})), ("2", json.dumps({"pageCount": 2, "data": {"articles": []}})), ("3", "<html>")):
        put(tmp_path, f"paged/source_key=p/{name}.json", content)
    for name, content in (("1", "<a class=x href='a'>b</a>\n<A HREF='c'>d</A>"), ("2", "<html>none</html>")):
        put(tmp_path, f"html/source_key=h/{name}.html", content)
    put(tmp_path, "lines/source_key=l/x.json", '{"i": 1}\n{broken\n{"i": 2}\n{}\n')
    at = lambda kind: str(tmp_path / kind)
    units = [failures.feed_units(spark, at("xml")), failures.grouped_units(spark, at("grouped")), failures.paged_units(spark, at("paged")), failures.page_units(spark, at("html")), failures.line_units(spark, at("lines"), "i long")]
    assert {tuple(r) for r in failures.counted(*units).collect()} == {
        ("a", "xml", 2, 2, "EmptyRecord: 1, MalformedXml: 1"),
        ("b", "xml", 0, 2, "MalformedXml: 1, NothingRead: 1"),
        ("g", "grouped", 2, 1, "MalformedJson: 1"),
        ("p", "paged", 1, 2, "MalformedJson: 1, NoPageNumber: 1"),
        ("h", "html", 2, 1, "NoAnchors: 1"),
        ("l", "lines", 2, 2, "EmptyRecord: 1, MalformedJson: 1"),
    }
    for u in units[:2]:
        failures.quarantine(u, at("aside"))
    kept = {(r["source_key"], r["error"], r["raw"].strip()) for r in spark.read.json(at("aside")).where("raw <> ''").collect()}
    assert kept == {("a", "MalformedXml", "<item><title>Two</item>"), ("b", "MalformedXml", "<item><title>cut"), ("g", "MalformedJson", '{"results": {"news": [')}
    # what is read is what the counts say, broken items and files aside
    assert sorted(r["title"] for r in readers.read_rss_articles(spark, at("xml/source_key=a")).collect()) == ["One", "Three"]


def test_pages_that_lack_come_late_or_come_again(spark, tmp_path):
    page = lambda i, n, *titles: json.dumps({"pageIndex": i, "pageCount": n, "data": {"articles": [{"title": f"{LONG} {t}", "releaseurl": t} for t in titles]}})
    put(tmp_path, "landing=1/source_key=accessnewswire/0.json", page(0, 4, "a", "b"))
    put(tmp_path, "landing=1/source_key=accessnewswire/3.json", page(3, 4, "d"))
    put(tmp_path, "landing=1/source_key=prnewswire/0.json", page(0, None, "x"))
    put(tmp_path, "landing=1/source_key=prnewswire/bad.json", "<html>")
    gaps = lambda at: sorted(map(tuple, readers.missing_pages(readers.folded_pages(readers.landed_pages(spark, at))).collect()))
    assert gaps(str(tmp_path / "landing=1")) == [("accessnewswire", 1), ("accessnewswire", 2)]
    put(tmp_path, "landing=2/source_key=accessnewswire/1.json", page(1, 6, "c"))
    put(tmp_path, "landing=2/source_key=accessnewswire/0.json", page(0, 6, "a2"))
    assert gaps(str(tmp_path)) == [("accessnewswire", 2), ("accessnewswire", 4), ("accessnewswire", 5)]
    rows = readers.read_paged_json(spark, str(tmp_path)).orderBy("source_key", "position").collect()
    assert [r["link"] for r in rows] == ["a2", "c", "d", "x"]
    assert gaps(str(tmp_path / "landing=1" / "source_key=prnewswire")) == []


def test_many_missing_pages_are_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(readers, "PAGE_BLOCK", 7)
    pages = spark.createDataFrame([("s", 20, 30), ("s", 3, 29), ("t", 0, 1), ("u", 0, 0)], "source_key string, page int, page_count int")
    assert sorted(map(tuple, readers.missing_pages(pages).collect())) == [("s", i) for i in range(30) if i not in (3, 20)]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    at = str(tmp_path / "latest")
    writers.write_latest(df, at)
    writers.write_latest(df.limit(1), at)
    assert writers.read_latest(spark, at).count() == 1
    at = str(tmp_path / "history")
    for t, n in (("t1", 3), ("t2", 2), ("t2", 1), ("t3", 1)):
        writers.write_history(df.limit(n), at, t)
    history = spark.read.parquet(at)
    assert {(r[0], r[1]) for r in history.groupBy("generated_at").count().collect()} == {("t1", 3), ("t2", 1), ("t3", 1)}
    assert writers.retained(history, "generated_at", 1).count() == 1
    assert writers.prune_history(spark, at, 0) == [] and writers.prune_history(spark, at, 2) == ["generated_at=t1"]
    assert {r[0] for r in spark.read.parquet(at).select("generated_at").distinct().collect()} == {"t2", "t3"}


def test_latest_is_replaced_as_a_whole(spark, tmp_path):
    at = str(tmp_path / "latest")
    with pytest.raises(FileNotFoundError):
        writers.read_latest(spark, at)
    assert writers.write_latest(spark.range(5), at) == 0
    seen = []

    def slow(folder):
        spark.range(2).write.parquet(folder)  # all is there, but under its hidden name
        seen.append(sorted(r[0] for r in writers.read_latest(spark, at).collect()))
        writers.write_latest(spark.range(9), at)  # another writer comes first

    assert writers.publish(spark, at, slow) == 2 and seen == [[0, 1, 2, 3, 4]]
    assert writers.versions(spark, at) == [1, 2] and writers.read_latest(spark, at).count() == 2
    assert writers.read_latest(spark, at, version=1).count() == 9
    with pytest.raises(FileNotFoundError):
        writers.read_latest(spark, at, version=0)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        writers.write_latest(bad, at)
    assert writers.read_latest(spark, at).count() == 2 and [p.name for p in (tmp_path / "latest").iterdir() if "pending" in p.name] == []
    assert writers.write_latest(spark.range(1), at, keep=1) == 3 and writers.versions(spark, at) == [3]
    assert writers.write_latest(spark.range(1), at, "json", keep=0) == 4 and writers.read_latest(spark, at, "json").count() == 1


def landed(spark, at, parts):
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.05)


@pytest.mark.parametrize("files", [1, 3])
def test_polling_claims_a_link_once_a_day(spark, tmp_path, files):
    def row(i, title, link, day="2024-01-01"):
        return (i, "structured_news", "prnewswire", "PR Newswire", title, "", link, day, "rss", "", None)

    rows = [row(0, "Apple one", "l1"), row(1, "Nvidia with Apple", "l2"), row(2, "Nvidia late", "l1"), row(3, "Nvidia next day", "l1", "2024-01-02"), row(4, "Apple no link", "")]
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    landed(spark, at, [rows] if files == 1 else [rows[:2], rows[2:3], rows[3:]])
    watch = spark.createDataFrame([(0, "AAPL", "Apple", []), (1, "NVDA", "Nvidia", [])], WATCHLIST)
    stream = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 1).parquet(at)
    stream.writeStream.foreachBatch(poll.refresh(watch, out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["ticker"], r["title"]) for r in spark.read.parquet(f"{out}/history").collect()}
    assert got == {("AAPL", "Apple one"), ("AAPL", "Nvidia with Apple"), ("NVDA", "Nvidia next day"), ("AAPL", "Apple no link")}
    seen = {(str(r["seen_day"]), r["link"]) for r in spark.read.parquet(f"{out}/seen").collect()}
    assert seen == {("2024-01-01", "l1"), ("2024-01-01", "l2"), ("2024-01-02", "l1"), ("2024-01-01", "")}
    assert writers.read_latest(spark, f"{out}/latest").count() >= 1


def test_seen_links_of_older_days_go(spark, tmp_path):
    row = lambda i, link, day: (i, "structured_news", "prnewswire", "PR Newswire", f"Apple {i}", "", link, day, "rss", "", None)
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    watch = spark.createDataFrame([(0, "AAPL", "Apple", [])], WATCHLIST)
    job = poll.refresh(watch, out, seen_days=1)
    for rows in ([row(0, "a", "2024-01-01")], [row(1, "a", "2024-01-01"), row(2, "b", "2024-01-02")], [row(3, "b", "2024-01-02"), row(4, "a", "2024-01-02")]):
        spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(at)
        spark.readStream.schema(ARTICLE).parquet(at).writeStream.foreachBatch(job).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r["title"] for r in spark.read.parquet(f"{out}/history").collect()} == {"Apple 0", "Apple 2", "Apple 4"}
    import os

    assert os.listdir(f"{out}/seen") == ["until=2024-01-02"]


def test_dates_of_all_forms_in_a_stream(spark, tmp_path):
    row = lambda i, link, day: (i, "structured_news", "prnewswire", "PR Newswire", f"Apple {i}", "", link, day, "rss", "", None)
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    watch = spark.createDataFrame([(0, "AAPL", "Apple", [])], WATCHLIST)
    job = poll.refresh(watch, out, seen_days=2, today=lambda n: f"2024-01-0{n + 2}")
    first = [row(0, "a", "Mon, 01 Jan 2024 10:00:00 GMT"), row(1, "b", ""), row(2, "c", "2024-01-01T23:30:00-05:00"), row(3, "d", "no date")]
    again = [row(4, "a", "2024-01-01"), row(5, "b", "2024-01-02"), row(6, "c", "02 Jan 2024"), row(7, "d", " "), row(8, "b", None)]
    for rows in (first, again):
        spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(at)
        spark.readStream.schema(ARTICLE).parquet(at).writeStream.foreachBatch(job).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    # a blank date has its batch's day: links b and d are of the 2nd first, then of the 3rd
    assert {r["title"] for r in spark.read.parquet(f"{out}/history").collect()} == {"Apple 0", "Apple 1", "Apple 2", "Apple 3", "Apple 7", "Apple 8"}


def test_claims_leave_the_state_by_timer(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "seen_day date, link string, watch_ord int"
    rows_kept = []

    def landed(*rows):
        spark.createDataFrame(rows, "d string, link string, watch_ord int").select(F.to_date("d").alias("seen_day"), "link", "watch_ord").write.mode("append").parquet(at)
        with claims.rocksdb(spark):
            made = claims.first_claims(spark.readStream.schema(schema).parquet(at), "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
            run = made.trigger(availableNow=True).start()
            run.awaitTermination()
        rows_kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
        return sorted((str(r[0]), r[1], r[2]) for r in spark.read.parquet(out).collect())

    first = landed(("2024-01-01", "a", 2), ("2024-01-01", "a", 1), ("2024-01-01", "b", 3), ("2024-01-01", "", 4))
    assert first == [("2024-01-01", "", 4), ("2024-01-01", "a", 1), ("2024-01-01", "b", 3)]
    # a smaller entry comes too late, the next day is free
    assert landed(("2024-01-01", "a", 0), ("2024-01-02", "a", 5)) == sorted([*first, ("2024-01-02", "a", 5)])
    # days that are over leave, and make no claim any more
    after = landed(("2024-01-05", "z", 5), ("2024-01-05", "z", 6))
    assert landed(("2024-01-01", "c", 0), ("2024-01-06", "z", 4)) == sorted([*after, ("2024-01-06", "z", 4)])
    assert rows_kept[:3] == [3, 4, 1] and rows_kept[3] == 2


def test_links_marked_by_a_collector(spark, tmp_path):
    at = str(tmp_path / "marked")
    rows = lambda *links: spark.createDataFrame([(x,) for x in links], "link string")
    got = [sorted(r[0] for r in poll.mark_collected(rows(*links), at, day).collect()) for links, day in ((("a", "b", "b"), "2024-01-01"), (("a", "c"), "2024-01-01"), (("a",), "2024-01-02"), (("c", "a"), "2024-01-02"))]
    assert got == [["a", "b", "b"], ["c"], ["a"], ["c"]]


def test_first_seen_stream(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 01:00:00", "a"), ("2024-01-02 01:00:00", "b")]
    df = spark.createDataFrame(rows, "t string, link string").select(F.to_timestamp("t").alias("ts"), "link")
    df.write.parquet(at)
    stream = poll.first_seen(spark.readStream.schema(df.schema).parquet(at)).select("seen_day", "link")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-s").trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r[0]), r[1]) for r in spark.read.parquet(out).collect()) == [("2024-01-01", "a"), ("2024-01-02", "a"), ("2024-01-02", "b")]


def test_adapters(spark):
    folder = "/root/testdata/sf0.001"
    rows = adapters.articles(spark, folder)
    assert set(rows.columns) == {f.name for f in ARTICLE.fields}
    assert rows.where("title IS NULL OR summary IS NULL OR link IS NULL OR text IS NULL OR source_name IS NULL").count() == 0
