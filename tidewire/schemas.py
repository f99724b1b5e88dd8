"""Column layouts of the tables that the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_text = ["source_group", "source_key", "source_name", "title", "summary", "link", "published", "collection_method", "text"]

#: One collected article. `article_id` is unique and doubles as input order; no text is null.
#: `feed_ticker` is set only for an article of a feed of one ticker.
ARTICLE = T.StructType([T.StructField("article_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in _text), T.StructField("feed_ticker", T.StringType())])

WATCHLIST = T.StructType(
    [
        T.StructField("watch_ord", T.IntegerType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("source_key", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_group", T.StringType()),
        T.StructField("is_ticker_specific", T.BooleanType()),
        T.StructField("is_premium", T.BooleanType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("href_contains", T.ArrayType(T.StringType())),
    ]
)
