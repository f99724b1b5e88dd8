"""Which article concerns which watchlist entry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, edged, filled
from ..sources.dimension import RSS
from ..sources.staging import spread, staged

#: Watchlist entries up to which every article is tested against the whole watchlist in its row.
BROADCAST_ENTRIES = 50
#: Keywords up to which a larger watchlist's index is broadcast (some 100 bytes each).
BROADCAST_KEYWORDS = 500_000
#: Characters of a gram of shorter keywords.
SHORT_GRAM = 4
#: Characters of a gram; one in so many articles is read for the frequency of grams, of which so many are told apart.
GRAM, SAMPLE, MOST_GRAMS = 6, 16, 20_000
#: Marks of indexed grams that an article's grams must hit before they leave its row: so many a gram, at most so many, a byte each.
MARKS, MOST_MARKS = 32, 1 << 22
#: Characters of a part of a text that is searched by itself, four times the longest keyword at least.
PART = 2_000
#: Bits of one bitmap that Spark makes.
BITMAP = 1 << 15
#: Grams below SHORT_GRAM that are looked for one by one; more are cut from the text.
LISTED = 200


def haystack(rss: Column) -> Column:
    """What the pre-filter looks through: title and summary, for feed articles also their text; in compact form."""
    parts = F.concat_ws(" ", *(F.nullif(filled(F.col(c)), F.lit("")) for c in ("title", "summary")), F.when(rss, F.nullif(filled(F.col("text")), F.lit(""))))
    return compact(parts)


def matched(terms: Column, edged_text: Column) -> Column:
    """The terms (term, edged) that stand in a text as a whole."""
    return F.transform(F.filter(terms, lambda t: F.contains(edged_text, t["edged"])), lambda t: t["term"])


def route(articles: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(article_id, watch_ord) that a feed allows: an article of one ticker's feed only meets that ticker."""
    mine = F.broadcast(watchlist.select("watch_ord", F.col("ticker").alias("__ticker")))
    allowed = F.col("feed_ticker").isNull() | (F.col("feed_ticker") == F.col("__ticker"))
    return articles.select("article_id", "feed_ticker").join(mine, allowed).select("article_id", "watch_ord")


def candidate_pairs(articles: DataFrame, needles: DataFrame, entries: int = BROADCAST_ENTRIES, keywords: int = BROADCAST_KEYWORDS) -> DataFrame:
    """Articles with the columns of each entry of `needles` that a keyword of theirs hits (see `hit_entries`)."""
    found, whole = _hit_entries(articles, needles, entries, keywords)
    found = found if whole else found.join(F.broadcast(needles), "watch_ord")
    return found.select(*articles.columns, *needles.columns)


def hit_entries(articles: DataFrame, needles: DataFrame, entries: int = BROADCAST_ENTRIES, keywords: int = BROADCAST_KEYWORDS) -> DataFrame:
    """Articles with the watch_ord of each entry of `needles` that a keyword of theirs hits.

    A keyword hits where its compact form is part of the article's compact form, across
    words too. A watchlist of at most `entries` entries is broadcast and every article is
    tested against it in one pass. A larger one is indexed (see `gram_index`): an article looks its
    grams up and tests the keywords found there literally. The index is broadcast up to
    `keywords` keywords, and marks of its grams are tested in the row first, so an article is only
    copied for grams that the index may have; a keyword that many entries share is tested once
    (see `_searched`). Beyond, grams and index meet by hash, and what they have in common is tested
    after a join by article_id, which is unique.
    """
    return _hit_entries(articles, needles, entries, keywords)[0].select(*articles.columns, "watch_ord")


def _hit_entries(articles: DataFrame, needles: DataFrame, entries: int, keywords: int) -> tuple[DataFrame, bool]:
    """Articles with their entries' watch_ord, and whether all columns of the entries are there; if not, the entries are few enough to broadcast."""
    small = needles.limit(entries + 1).count() <= entries
    hay = articles.withColumn("__hay", haystack(F.col("source_group") == RSS))
    allowed = F.col("feed_ticker").isNull() | (F.col("feed_ticker") == F.col("ticker"))
    if small:
        hit = F.exists("short_keywords", lambda k: F.contains(F.col("__hay"), k))
        return hay.join(F.broadcast(needles), allowed & hit).drop("__hay"), True
    hay = spread(hay)
    index = staged(gram_index(needles, _frequent_grams(hay)))
    few = index.limit(keywords + 1).count() <= keywords
    grams = _lookup(F.col("__part" if few else "__hay"), index, marked=few)
    if few:
        return _searched(hay, grams, index, needles), False
    # of the keywords of an entry that hit only the first counts, so no pair comes twice
    hit = F.contains(F.col("__hay"), F.col("__keyword")) & ~F.exists("__before", lambda k: F.contains(F.col("__hay"), k))
    met = hay.select("article_id", F.explode(grams).alias("__gram")).join(index, "__gram").drop("__gram")
    found = hay.join(met, "article_id").where(hit).drop("__hay", "__keyword", "__before")
    return found.join(needles, "watch_ord").where(allowed), True


def _searched(hay: DataFrame, grams: Column, index: DataFrame, needles: DataFrame) -> DataFrame:
    """hay, without its text, with the watch_ord of each entry of a broadcast index that a keyword hits and the feed allows.

    A text is searched for distinct keywords, so the search doesn't grow with the entries that
    share them, in parts (see `_parts`), so that it grows with its length only. Its hits, summed by 128 bits of the text, then meet groups of entries. What a pair
    costs is only its row: tests are made a group (see `_entry_groups`).
    """
    keyed = hay.withColumns({"__h1": F.xxhash64("__hay"), "__h2": F.xxhash64(F.lit(1), "__hay")})
    words = staged(index.select("__gram", "__keyword").distinct().withColumn("__id", F.monotonically_increasing_id()))
    longest = words.agg(F.max(F.length("__keyword"))).first()[0] or 1
    parts = keyed.select("__h1", "__h2", F.explode(_parts(F.col("__hay"), longest)).alias("__part"))
    met = parts.select("__h1", "__h2", "__part", F.explode(grams).alias("__gram")).join(F.broadcast(words), "__gram")
    hits = met.where(F.contains(F.col("__part"), F.col("__keyword"))).groupBy("__h1", "__h2").agg(F.collect_set("__id").alias("__hits"))
    own = needles.groupBy(F.col("ticker").alias("feed_ticker")).agg(F.collect_list("watch_ord").alias("__own"))
    each = keyed.drop("__hay").join(hits, ["__h1", "__h2"]).drop("__h1", "__h2").join(F.broadcast(own), "feed_ticker", "left")
    sooner = F.when(F.size("__before") == 1, F.array_contains("__hits", F.get("__before", F.lit(0)))).otherwise(F.arrays_overlap("__before", "__hits"))
    groups = each.withColumn("__id", F.explode("__hits")).join(F.broadcast(_entry_groups(index, words)), "__id").where((F.size("__before") == 0) | ~sooner)
    entries = F.when(F.col("feed_ticker").isNull(), F.col("__entries")).otherwise(F.array_intersect("__entries", F.coalesce("__own", F.array().cast("array<int>"))))
    return groups.select(*hay.drop("__hay").columns, F.explode(entries).alias("watch_ord"))


def _parts(c: Column, longest: int) -> Column:
    """A text in parts that each begin `longest` - 1 characters before the one before ends, so that all it holds of that length is whole in one."""
    size = max(PART, 4 * longest)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size - longest + 1)), lambda i: F.substring(c, i, F.lit(size)))


def _entry_groups(index: DataFrame, words: DataFrame) -> DataFrame:
    """(id, before, entries): entries that have a keyword and the same keywords before it, those that most entries share first.

    Of the keywords of an entry that hit only the first counts, so no pair comes twice; with the
    shared ones first, most entries have none before and the groups are large.
    """
    named = index.join(words, "__keyword").select("watch_ord", "__id")
    shared = named.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"))
    ranked = named.join(shared, "__id").groupBy("watch_ord").agg(F.array_sort(F.collect_list(F.struct(-F.col("__n"), "__id"))).alias("__all"))
    each = ranked.select("watch_ord", F.col("__all.__id").alias("__all"), F.posexplode("__all.__id").alias("__at", "__id"))
    return each.groupBy("__id", F.slice("__all", F.lit(1), F.col("__at")).alias("__before")).agg(F.collect_list("watch_ord").alias("__entries"))


def _grams(c: Column, sizes: list[int]) -> Column:
    """The grams of these sizes of a compact text, repeats included."""
    of = [F.regexp_extract_all(c, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]  # overlapping, in one pass of the text each
    return F.concat(*of) if of else F.array().cast("array<string>")


def _lookup(c: Column, index: DataFrame, marked: bool) -> Column:
    """The distinct grams of a compact text that the index may have; its bounds need a broadcast index if `marked`."""
    sizes = dict(index.groupBy(F.length("__gram").alias("size")).agg(F.count_distinct("__gram").alias("n")).collect())  # SHORT_GRAM + 1 rows at most
    short = [n for n in sizes if n < SHORT_GRAM]
    if sum(sizes[n] for n in short) > LISTED:
        short = []
    cut = _grams(c, sorted(n for n in sizes if n not in short))
    if marked and sizes:
        cut = F.filter(cut, _marks(index, sum(sizes.values())))
    if short:
        listed = [r[0] for r in index.where(F.length("__gram").isin(short)).select("__gram").distinct().collect()]  # LISTED at most
        cut = F.concat(cut, F.filter(F.array(*map(F.lit, listed)), lambda g: F.contains(c, g)))
    return F.array_distinct(cut)


def _marks(index: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that all n grams of the index pass, and others seldom: bitmaps made by Spark, MOST_MARKS / BITMAP rows at most, in one literal."""
    slots = max(BITMAP, min(MOST_MARKS, 1 << (MARKS * n - 1).bit_length()))
    slot = lambda gram: F.pmod(F.xxhash64(gram), F.lit(slots)) + 1
    numbered = index.select(slot(F.col("__gram")).alias("slot"))
    made = numbered.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    marks = np.zeros(slots, np.uint8)
    for bucket, bits in made:
        marks[(bucket - 1) * BITMAP : bucket * BITMAP] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    every = F.lit(marks.tobytes())
    return lambda gram: F.substring(every, slot(gram).cast("int"), F.lit(1)) == F.lit(b"\x01")


def _frequent_grams(hay: DataFrame) -> DataFrame:
    """(gram, n): grams of GRAM characters and how many of one in SAMPLE articles have them, the most frequent MOST_GRAMS."""
    some = hay.where(F.pmod(F.xxhash64("article_id"), F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(_grams(F.col("__hay"), [GRAM]))).alias("gram"))
    return some.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(MOST_GRAMS)


def gram_index(needles: DataFrame, frequent: DataFrame) -> DataFrame:
    """(gram, watch_ord, keyword, before): every keyword under the rarest of its grams, with the entry's keywords before it.

    A text that holds a keyword holds all of its grams, so any one may stand for it; the rarest by
    a sample of the articles is looked up the least. A keyword shorter than SHORT_GRAM is its own gram.
    """
    listed = needles.select("watch_ord", "short_keywords", F.posexplode("short_keywords").alias("at", "__keyword"))
    listed = listed.select("watch_ord", "at", "__keyword", F.slice("short_keywords", 1, F.col("at")).alias("__before")).where("__keyword <> ''")
    size = F.when(F.length("__keyword") >= GRAM, GRAM).when(F.length("__keyword") >= SHORT_GRAM, SHORT_GRAM).otherwise(F.length("__keyword"))  # few sizes, as each is a pass of the text
    own = F.transform(F.sequence(F.lit(1), F.length("__keyword") - size + 1), lambda i: F.substring("__keyword", i, size))
    known = F.broadcast(frequent.withColumnsRenamed({"gram": "__gram", "n": "__n"}))
    rated = listed.withColumn("__gram", F.explode(F.array_distinct(own))).join(known, "__gram", "left")
    rarest = F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram"))
    return rated.groupBy("watch_ord", "at").agg(rarest["__gram"].alias("__gram"), F.first("__keyword").alias("__keyword"), F.first("__before").alias("__before")).drop("at")


def filter_by_text(articles: DataFrame, keywords: list[str], text_col: str = "text") -> DataFrame:
    """Articles whose text contains a keyword as it stands, in lower case; without keywords all of them."""
    if not keywords:
        return articles
    text = F.lower(filled(F.col(text_col)))
    return articles.where(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k)))


def edged_texts(df: DataFrame) -> DataFrame:
    """df with the edged title and summary, made once an article and not once a pair."""
    return df.withColumns({"__title": edged(F.col("title")), "__summary": edged(F.col("summary"))})
