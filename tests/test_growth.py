"""Steps whose cost must grow no faster than their input: what they read, make once or hold at a time."""

from pyspark.sql import functions as F

from tidewire import queries
from tidewire.functions import text
from tidewire.operators import reports
from tidewire.plans.snapshot import Snapshot
from tidewire.sources import adapters, readers, staging

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_link_is_taken_apart_once(spark):
    links = spark.createDataFrame([("HTTP://A.com//x/?q",), ("file:///X/",), ("//Host",), ("x#f",), (" \t/",), ("",), (None,)], "c string")
    made = links.select(text.canonical_link(F.col("c")).alias("link"))
    assert [r[0] for r in made.collect()] == ["http://a.com//x", "file:/X", "//host/", "x", "/", "", ""]
    assert plan(made).count("regexp_extract(") == 1


def test_routed_pairs_move_without_texts(spark):
    job = Snapshot(adapters.articles(spark, SMALL), adapters.watchlist(spark))
    assert not hasattr(job.routed, "_staged_at")
    narrow = job.routed.select("article_id", "watch_ord", "bucket")
    assert "summary#" not in plan(narrow) and narrow.count() == job.counted.count()
    assert "title" not in job.counted.columns


def test_a_snapshot_that_is_written_twice_is_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "Snapshot", lambda *a: made.append(Snapshot(*a)) or made[-1])
    assert queries.write_snapshot(spark, SMALL).count() == 6 and len(made) == 1
    assert hasattr(made[0].stats, "_staged_at")


def test_a_keyword_of_many_entries_is_tested_once_a_text(spark):
    from tidewire.operators import matching, profiles
    from tidewire.schemas import ARTICLE, WATCHLIST
    from tidewire.sources.dimension import RSS

    texts = ["common word here", "common word here", "nothing", "ticker no 3 and common", ""]
    rows = [(i % 4, RSS, "k", "n", "", "", "", "", "rss", t, None) for i, t in enumerate(texts)]  # an id comes twice
    watch = [(i, f"Ticker no {i}", "common", ["word", "else"]) for i in range(60)]
    needles = profiles.needles(profiles.profiles(spark.createDataFrame(watch, WATCHLIST)))
    found = matching.candidate_pairs(spark.createDataFrame(rows, ARTICLE), needles)
    assert sorted(map(tuple, found.select("article_id", "watch_ord").collect())) == sorted((i % 4, w) for i, t in enumerate(texts) for w in range(60) if "common" in t)
    tested = [line for line in plan(found).splitlines() if "Contains(" in line]
    assert tested and not any("watch_ord" in line or "__before" in line for line in tested)


def test_a_long_text_is_searched_in_parts_and_pairs_are_tested_in_groups(spark, monkeypatch):
    from tidewire.operators import matching, profiles
    from tidewire.schemas import ARTICLE, WATCHLIST
    from tidewire.sources.dimension import RSS

    monkeypatch.setattr(matching, "PART", 64)
    words = ["keyword", "another", "somethingelse"]
    texts = ["x" * i + words[i % 3] + "y" * 40 + words[i % 2] for i in range(150)] + ["", "z" * 300]
    rows = [(i, RSS, "k", "n", "", "", "", "", "rss", t, None if i % 5 else f"T{i}") for i, t in enumerate(texts)]
    watch = [(i, f"T{i}", words[i % 3], [words[i % 2], "nowhere"]) for i in range(90)]
    needles = profiles.needles(profiles.profiles(spark.createDataFrame(watch, WATCHLIST)))
    found = matching.hit_entries(spark.createDataFrame(rows, ARTICLE), needles)
    want = [(i, w) for i, t in enumerate(texts) for w in range(90) if (i % 5 or i == w) and (words[w % 3] in t or words[w % 2] in t)]
    assert sorted(map(tuple, found.select("article_id", "watch_ord").collect())) == want
    tested = [line for line in plan(found).splitlines() if "Contains(" in line]
    assert tested and all("Contains(__part" in line and "Contains(__hay" not in line for line in tested)
    index = matching.gram_index(needles, spark.createDataFrame([], "gram string, n long"))
    listed = index.select("__keyword").distinct().withColumn("__id", F.monotonically_increasing_id())
    groups = matching._entry_groups(index, listed).join(listed, "__id").where(F.col("__keyword").isin(words)).collect()
    assert len(groups) < 10 and sum(len(g["__entries"]) for g in groups) == 150


def test_anchors_leave_a_task_in_small_parts(spark, monkeypatch):
    from tidewire.functions import markup

    page = "<a href='/1'>one</a><a href='/2'>two</a>"
    pages = spark.createDataFrame([(i, page, "http://x/") for i in range(3 * markup.PAGES)], "page_id long, html string, url string").coalesce(1)
    taken = []
    monkeypatch.setattr(type(pages), "mapInPandas", lambda df, run, schema: taken.append(run) or df)
    markup.anchors(pages, "page_id", "html", "url")
    parts = list(taken[0](iter([pages.toPandas()])))
    assert [len(p) for p in parts] == [2 * markup.PAGES] * 3


def test_nested_snapshots_are_read_once(spark, tmp_path):
    stories = '[{"source_name": "A", "coverage_sources": ["A", "B"]}, {"source_name": ""}]'
    (tmp_path / "1.json").write_text(f'{{"tickers": [{{"ticker": "X", "stories": {stories}}}, {{"ticker": "Y", "source_usage": {{"raw_matches": {{"A": 3}}, "primary_stories": {{"A": 2}}}}, "stories": {stories}}}]}}')
    (tmp_path / "2.json").write_text(f'{{"ticker": "X", "stories": {stories}}}')
    (tmp_path / "3.json").write_text('{"ticker": "Y", "source_usage": {"raw_matches": {"A": 3}}}')
    (tmp_path / "4.json").write_text('{"tickers": []}')
    tickers = readers.read_snapshot(spark, str(tmp_path))
    assert sorted(r["ticker"] for r in tickers.collect()) == ["X", "X", "Y", "Y"] and plan(tickers).count("FileScan json") == 1
    usage = reports.usage_of_snapshot(tickers)
    assert plan(usage).count("FileScan json") == 1
    primary, cover = "primary_stories", "primary_story_coverage"
    want = [("X", primary, "A", 2), ("X", cover, "A", 2), ("X", cover, "B", 2), ("Y", cover, "A", 1), ("Y", cover, "B", 1), ("Y", primary, "A", 2), ("Y", "raw_matches", "A", 3), ("Y", "raw_matches", "A", 3)]
    assert sorted(map(tuple, usage.collect())) == sorted(want)


def test_pairs_are_counted_without_their_texts(spark):
    job = Snapshot(adapters.articles(spark, SMALL), adapters.watchlist(spark))
    assert not hasattr(job.counted, "_staged_at") and hasattr(job.tally, "_staged_at")
    for text_column in ("title#", "title_key#", "canonical_link#", "rejection_reasons#", "matched_identity#"):
        assert text_column not in plan(job.counted)
    assert job.tally.agg(F.sum("n")).first()[0] == job.counted.count() > job.tally.count()


def test_parts_of_a_table_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(staging, "PART_ROWS", 100)
    rows = spark.range(0, 2_001, 1, 5)
    parts = staging.spread(rows).rdd.glom().map(len).collect()
    assert len(parts) == 21 and sum(parts) == 2_001 and max(parts) <= 200
    assert staging.spread(spark.range(0, 2_001, 1, 30)).rdd.getNumPartitions() == 30


def test_a_model_is_fitted_on_counts_that_are_made_once(spark, monkeypatch):
    from tidewire.operators import sentiment

    kept = []
    plain = sentiment.staged
    monkeypatch.setattr(sentiment, "staged", lambda df: kept.append(plain(df)) or kept[-1])
    rows = [(i, "good words here" if i % 2 else "bad news there", "positive" if i % 2 else "negative") for i in range(60)]
    docs = spark.createDataFrame(rows, "article_id long, text string, label string")
    model = sentiment.fit_model(docs, features=64)
    assert len(kept) == 1 and {"__wn", "__pn", "__label"} <= set(kept[0].columns) and not {"__text", "__words"} & set(kept[0].columns)
    assert all(r["label"] == rows[r["article_id"]][2] for r in sentiment.scored_by(model, docs).collect())
