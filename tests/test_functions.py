"""Text functions and rules, by hand and against a Python model on random rows."""

import random
import re
from html import unescape
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from tidewire.functions import rules, text

random.seed(3)
LETTERS = list("ab1 .+-\n\té,AB")


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def some(n=300, k=14):
    return [None, "", " "] + ["".join(random.choices(LETTERS, k=random.randint(0, k))) for _ in range(n)]


def test_normal_forms(spark):
    rows = some()
    full = [r or "" for r in rows]
    assert column(spark, rows, text.squeezed) == [" ".join(r.split()) for r in full]
    assert column(spark, rows, text.phrase) == [" ".join(r.lower().split()) for r in full]
    assert column(spark, rows, text.spaced) == [re.sub("[^a-z0-9]+", " ", r.lower()).strip() for r in full]
    assert column(spark, rows, text.compact) == [re.sub("[^a-z0-9]+", "", r.lower()) for r in full]


def test_markup(spark):
    rows = [None, "<p>a &amp; b</p>", "&lt;b&gt;x&lt;/b&gt;", "x &eacute; &#8217; <br/>\n y", "no tags", "a < b"]
    assert column(spark, rows, text.without_markup) == ["", "a & b", "<b>x</b>", "x é ’ y", "no tags", "a < b"]
    assert column(spark, rows, text.headline_text) == [" ".join(unescape(r or "").split()) for r in rows]
    page = "<html><TITLE lang='x'>A\n&amp; B</TITLE><script>var x = '<p>';</script><body>hi<style>p{}</style> there<noscript>no</noscript></body>"
    assert column(spark, [page, None, "<p>none</p>"], text.page_title) == ["A & B", "", ""]
    assert column(spark, [page], text.page_text) == ["A & B hi there"]


def test_terms_stand_alone(spark):
    terms = ["a", "b1", "a b", "é", "b.", "1", "ab", "a-b"]
    rows = [r for r in some(400, 10) if r is not None]
    df = spark.createDataFrame([(r, t) for r in rows for t in terms], "t string, term string")
    for r in df.withColumn("hit", F.contains(text.edged(F.col("t")), text.edged(F.col("term")))).collect():
        pattern = re.escape(r["term"]).replace(r"\ ", r"\s+")
        want = re.search(rf"(?<![a-z0-9]){pattern}(?![a-z0-9])", r["t"], re.I) is not None
        assert r["hit"] == want, r


def test_links(spark):
    links = ["", None, "HTTP://Ex.COM:80/A/b/?q=1#x", "https://u:P@h.com", "//H/p/", "/only/path///", "mailto:Me@x", "  https://a.b/c\n/d", "https://a.b?x=1"]

    def want(link):
        if not link:
            return ""
        p = urlsplit(link)
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", "", ""))

    assert column(spark, links, text.canonical_link) == [want(x) for x in links]
    home = "https://site.com/a/news.html?p=1"
    hrefs = ["/x", "https://o.com/y", "//cdn.com/z", "rel", "", "mailto:a@b"]
    got = column(spark, hrefs, lambda c: text.resolved_link(c, F.lit(home)))
    assert got == [urljoin(home, h) for h in hrefs]


def test_headlines(spark):
    rows = ["a b c" * 5, "request a demo", "too short", "x" * 300, "one two34567890123456", "exactly 18 chars a", "w " * 129 + "ab"]
    want = [18 <= len(r) <= 260 and r.count(" ") >= 2 and r != "request a demo" for r in rows]
    assert column(spark, rows, text.is_headline) == want


def test_rounding(spark):
    values = [(s * 0.5 * w * (1 + 0.15 * (n - 1)),) for s in range(0, 80) for w in (1.0, 0.95, 0.9, 0.85, 0.75, 0.7, 0.5) for n in (1, 2, 3, 7, 40)] + [(-3.125,), (2.675,), (0.0,)]
    rows = spark.createDataFrame(values, "x double").select("x", text.rounded(F.col("x")).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 2) for r in rows)


@pytest.mark.parametrize(
    ("title", "summary", "want"),
    [
        ("Apple names new CEO after earnings", "", "executive_change"),
        ("Apple wins analyst upgrade", "", "analyst_rating_or_target"),
        ("Firm hikes Apple target", "", "analyst_rating_or_target"),
        ("Apple Q3 beats", "names new ceo", "earnings_or_guidance"),
        ("Apple faces export controls", "", "regulatory_or_geopolitical"),
        ("Apple launched it", "", "product_or_strategy"),
        ("Apple at a record", "", "market_reaction"),
        ("Apple vs rivals", "", "comparison_or_context"),
        ("Apple news", "it steps down", "executive_change"),
        ("Apple proximity dealings", "", "general_company_focus"),
        (None, None, "general_company_focus"),
    ],
)
def test_events(spark, title, summary, want):
    got = rules.with_event(spark.createDataFrame([(title or "", summary or "")], "title string, summary string")).first()
    assert got["event_type"] == want and got["event_weight"] == dict((e[0], e[1]) for e in [*rules.EVENTS, rules.OTHER_EVENT])[want]


def test_roundups_and_context(spark):
    rows = ["Top stories now", "top 10 picks", "3 stocks to buy", "5 out of 7", "laptop stories", "stock 3"]
    assert column(spark, rows, rules.is_roundup) == [True, True, True, True, False, False]
    assert column(spark, ["évs x", "é vs x", "vs é"], rules.is_context) == [False, True, True]
    rows = ["A vs B", "canvas", "Magnificent Seven", "record highs", "record high"]
    assert column(spark, rows, rules.is_context) == [True, False, True, True, False]
