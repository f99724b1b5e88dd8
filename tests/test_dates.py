"""Dates of landed articles."""

from pyspark.sql import functions as F

from tidewire.functions import dates

READ = {
    "Mon, 01 Jan 2024 10:00:00 GMT": "2024-01-01 10:00:00",
    "01 Jan 2024 10:00:00 +0200": "2024-01-01 08:00:00",
    "Mon, 1 Jan 24 23:30 EST": "2024-01-02 04:30:00",
    "Tue, 2 Jan 2024 10:00:00 GMT (UTC)": "2024-01-02 10:00:00",
    "Fri, 31 Dec 99 23:59:59 PDT": "2000-01-01 06:59:59",
    "Mon, 01 Jan 2024": "2024-01-01 00:00:00",
    "2024-01-01T10:00:00Z": "2024-01-01 10:00:00",
    "2024-01-01T10:00:00.123+02:00": "2024-01-01 08:00:00",
    "2024-01-01T10:00:00-0530": "2024-01-01 15:30:00",
    "2024-01-01 10:00": "2024-01-01 10:00:00",
    " 2024-02-29 ": "2024-02-29 00:00:00",
    "January 5, 2024 4:05 PM EST": "2024-01-05 21:05:00",
    "Friday, January 5, 2024 at 12:05 am": "2024-01-05 00:05:00",
    "Jan. 5, 2024": "2024-01-05 00:00:00",
}
UNREAD = ["", " ", None, "Mon", "soon", "2024-13-45", "2024-02-30", "Mon, 32 Jan 2024 10:00:00 GMT", "2024-01-01T25:00:00Z", "2024-01-01T10:00:00+99:00", "1 Foo 2024", "9999999999", "x" * 5000, "1 Jan 2024 " + "(" * 3000]


def test_all_forms_in_any_session_zone(spark):
    df = spark.createDataFrame([(x,) for x in [*READ, *UNREAD]], "p string").repartition(2)
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            at = df.withColumn("at", dates.published_at(F.col("p")))
            rows = at.select("p", F.to_utc_timestamp("at", F.current_timezone()).cast("string").alias("utc"), dates.utc_day(F.col("at")).cast("string").alias("day")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert {r["p"]: r["utc"] for r in rows} == {**READ, **dict.fromkeys(UNREAD)}
        assert {r["p"]: r["day"] for r in rows} == {**{k: v[:10] for k, v in READ.items()}, **dict.fromkeys(UNREAD)}
