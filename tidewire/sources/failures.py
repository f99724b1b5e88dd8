"""What can't be read of landed files of any kind: named, counted by source, and put aside.

Every function gives a row a unit (an item of a feed, a JSON file, a JSON line, a page), and a
unit that is broken never holds up another; a file that gives nothing at all is named too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import filled
from .readers import GROUPED, ITEM, PAGED, of_path

#: Names of failures.
MALFORMED_XML, MALFORMED_JSON, EMPTY, NO_PAGE_NUMBER, NO_ANCHORS, NOTHING_READ = "MalformedXml", "MalformedJson", "EmptyRecord", "NoPageNumber", "NoAnchors", "NothingRead"
BROKEN = "__broken"


def _reader(spark: SparkSession, ddl: str):
    """A reader that keeps what it can't parse, and leaves out files it can't open."""
    schema = T.StructType.fromDDL(ddl).add(BROKEN, T.StringType())
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("ignoreCorruptFiles", True)


def _blank(ddl: str) -> Column:
    """Whether a record has none of its fields."""
    return reduce(Column.__and__, (F.col(f.name).isNull() for f in T.StructType.fromDDL(ddl).fields))


def _units(rows: DataFrame, kind: str, error: Column, rows_read: Column, raw: Column) -> DataFrame:
    return rows.select(of_path("source_key").alias("source_key"), F.lit(kind).alias("kind"), F.input_file_name().alias("file"), error.alias("error"), F.when(error.isNull(), rows_read).otherwise(0).cast("bigint").alias("rows_read"), F.when(error.isNotNull(), raw).alias("raw"))


def _with_silent_files(units: DataFrame, spark: SparkSession, path: str, kind: str) -> DataFrame:
    """units and a row for each file that has none: an empty or an unreadable one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.regexp_extract("path", "source_key=([^/]+)", 1).alias("source_key"))
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([a-z]+):/+", "$1:/")  # noqa: E731  both as one form of the same path
    silent = files.withColumn("__file", plain(F.col("file"))).join(units.select(plain(F.col("file")).alias("__file")).distinct(), "__file", "left_anti")
    none = silent.select("source_key", F.lit(kind).alias("kind"), "file", F.lit(NOTHING_READ).alias("error"), F.lit(0).cast("bigint").alias("rows_read"), F.lit("").alias("raw"))
    return units.unionByName(none)


def feed_units(spark: SparkSession, path: str) -> DataFrame:
    """Items of XML feeds below path/source_key=..."""
    items = _reader(spark, ITEM).format("xml").option("rowTag", "item").option("useLegacyXMLParser", True).load(path)
    error = F.when(F.col(BROKEN).isNotNull(), MALFORMED_XML).when(_blank(ITEM), EMPTY)
    return _with_silent_files(_units(items, "xml", error, F.lit(1), F.col(BROKEN)), spark, path, "xml")


def grouped_units(spark: SparkSession, path: str) -> DataFrame:
    """Files of grouped news; one without news has no rows and is no failure."""
    files = _reader(spark, GROUPED).option("multiLine", True).json(path)
    groups = F.coalesce("results.news", F.array().cast("array<struct<newsitem:array<struct<source:string,headline:string,storyurl:string,datetime:string,qmsummary:string>>>>"))
    n = F.aggregate(groups, F.lit(0), lambda a, g: a + F.greatest(F.coalesce(F.size(g["newsitem"]), F.lit(0)), F.lit(0)))
    return _with_silent_files(_units(files, "grouped", F.when(F.col(BROKEN).isNotNull(), MALFORMED_JSON), n, F.coalesce(F.col(BROKEN), F.to_json("results"))), spark, path, "grouped")


def paged_units(spark: SparkSession, path: str) -> DataFrame:
    """Page files of a paged list."""
    files = _reader(spark, PAGED).option("multiLine", True).json(path)
    error = F.when(F.col(BROKEN).isNotNull(), MALFORMED_JSON).when(F.col("pageIndex").isNull(), NO_PAGE_NUMBER)
    n = F.greatest(F.coalesce(F.size("data.articles"), F.lit(0)), F.lit(0))
    return _with_silent_files(_units(files, "paged", error, n, F.coalesce(F.col(BROKEN), F.to_json(F.struct("pageCount", "data")))), spark, path, "paged")


def page_units(spark: SparkSession, path: str) -> DataFrame:
    """HTML pages, a file each; rows_read counts anchors with a link."""
    pages = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True)
    n = F.regexp_count(filled(F.col("value")), F.lit(r"(?i)<a\s[^>]*href\s*="))
    return _with_silent_files(_units(pages, "html", F.when(n == 0, NO_ANCHORS), n, F.col("value")), spark, path, "html")


def line_units(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines with the fields of `ddl`."""
    lines = _reader(spark, ddl).json(path)
    error = F.when(F.col(BROKEN).isNotNull(), MALFORMED_JSON).when(_blank(ddl), EMPTY)
    return _with_silent_files(_units(lines, "lines", error, F.lit(1), F.col(BROKEN)), spark, path, "lines")


def counted(*units: DataFrame) -> DataFrame:
    """(source_key, kind, rows_read, failed, errors): errors lists the names of the failures with their counts.

    Names are summed first and listed then, so a source with many failures is few rows.
    """
    by_name = reduce(DataFrame.unionByName, units).groupBy("source_key", "kind", "error").agg(F.sum("rows_read").alias("rows_read"), F.count("error").alias("n"))
    named = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "error", F.col("n").cast("string")))
    return by_name.groupBy("source_key", "kind").agg(F.sum("rows_read").alias("rows_read"), F.sum("n").alias("failed"), F.array_join(F.array_sort(F.collect_list(named)), ", ").alias("errors"))


def quarantine(units: DataFrame, path: str) -> None:
    """Add the failed units to path, by source, as they came, so that they can be mended and read again."""
    units.where("error IS NOT NULL").drop("rows_read").write.mode("append").partitionBy("source_key").json(path)
