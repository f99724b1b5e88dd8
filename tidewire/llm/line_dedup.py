"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line, the pages of the host that contain it are divided
by all pages of the host; lines above the boilerplate ratio are dropped from the host's
pages. Only 16-byte line keys are shuffled, counted in every task first, so a host with a
third of all pages is spread by its lines. Lines are compared by a 128-bit key.

A host has at most (lines of a page) / ratio such lines, but hosts and lines of a page have
no bound; so the found lines are counted, broadcast if they are at most BROADCAST_LINES, and
joined to the lines of the pages otherwise.

Defined results: a null text stays null and has no lines; lines are what lies between
newlines, as they stand; blank lines are never dropped; a line is counted once a page; a
null host is a host of its own; repeated rows count as pages each; a column with the name of
a result is replaced by it; a line on one page only is no repetition and stays, whatever its
ratio; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, others

RATIO = 0.05
#: Pages of a host that make a line of theirs a repetition.
REPEATED = 2
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO) -> DataFrame:
    """(host, a, b, pages): keys of the lines above the ratio on their host."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("t"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    # distinct lines of a page, blank ones left out
    some = F.filter(F.array_distinct(_lines(F.col("t"))), lambda x: F.trim(x) != "")
    lines = pages.select("host", F.explode(some).alias("line")).select("host", _key(F.col("line")).alias("k")).select("host", "k.a", "k.b")
    counted = lines.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= REPEATED)
    # null hosts meet each other too
    return counted.join(total.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > ratio * F.col("host_pages")).select("host", "a", "b", "pages")


def annotate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, limit: int = BROADCAST_LINES, prefix: str = "") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped, each name after `prefix`."""
    found = materialise(boilerplate(docs, host_col, text_col, ratio), "boilerplate")
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("-"))
    keyed = found.select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("-")).alias("__tw_host"), "a", "b")
    lines = F.transform(_lines(F.col(text_col)), lambda x: F.struct(x.alias("line"), _key(x).alias("k")))
    if found.count() <= limit:
        per_host = keyed.groupBy("__tw_host").agg(F.collect_list(F.struct("a", "b")).alias("__tw_bad"))
        out = docs.withColumn("__tw_host", host).join(F.broadcast(per_host), "__tw_host", "left")
        out = out.withColumn("__tw_lines", lines)
        # by hash: which lines of the page are among those of the host; then only these are looked for
        hit = F.array_intersect(F.transform("__tw_lines", lambda x: x["k"]), "__tw_bad")
        out = out.withColumn("__tw_hit", F.coalesce(hit, F.array().cast("array<struct<a: bigint, b: bigint>>")))
        kept = F.filter("__tw_lines", lambda x: (F.trim(x["line"]) == "") | ~F.array_contains("__tw_hit", x["k"]))
        kept = F.when(F.size("__tw_hit") > 0, F.transform(kept, lambda x: x["line"])).otherwise(_lines(F.col(text_col)))
    else:
        out = materialise(docs.withColumn("__tw_host", host).withColumn("__tw_row", F.monotonically_increasing_id()), "pages")
        spread = out.select("__tw_row", "__tw_host", F.posexplode(lines).alias("at", "x")).where(F.trim("x.line") != "").select("__tw_row", "__tw_host", "at", "x.k.a", "x.k.b")
        drop = spread.join(keyed, ["__tw_host", "a", "b"], "left_semi").groupBy("__tw_row").agg(F.collect_list("at").alias("__tw_drop"))
        out = out.join(drop, "__tw_row", "left")
        kept = F.filter(_lines(F.col(text_col)), lambda x, i: ~F.array_contains(F.coalesce("__tw_drop", F.array().cast("array<int>")), i))
    out = out.withColumn("__tw_kept", kept).withColumn("__tw_n", F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0)))
    made = {
        "kept_text": F.array_join("__tw_kept", "\n"),
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__tw_n")).cast("bigint"),
        "n_dropped": F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__tw_n") - F.size("__tw_kept")).cast("bigint"),
    }
    made = {prefix + k: c for k, c in made.items()}
    return out.select(*others(docs, list(made), host_col, text_col), *(c.alias(k) for k, c in made.items()))


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs without the boilerplate lines of their hosts."""
    out = annotate(docs, host_col, text_col, prefix="__tw_", **options)
    return out.withColumn(text_col, F.col("__tw_kept_text")).select(*docs.columns)
