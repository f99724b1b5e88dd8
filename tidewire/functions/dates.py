"""Dates of landed articles, typed. Nothing here throws: what no form takes is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Hours from UTC of the zones that feeds name; any other name counts as UTC, as mail standards have it.
ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "et": -5, "cet": 1, "cest": 2, "bst": 1, "jst": 9}
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
ZONE = r"([+-]\d{2}:?\d{2}|[a-z]{1,5})?(?:\s*\([^)]*\))?"
#: A form and where it has year, month, day, hour, minute, second, half of the day, zone ($9 is never set).
FORMS = [
    # Mon, 01 Jan 2024 10:00:00 GMT; 1 Jan 24 10:00 +0200
    (rf"(?i)^(?:[a-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s-]+([a-z]{{3,9}})\.?[\s-]+(\d{{4}}|\d{{2}})(?:,?\s+{CLOCK}\s*{ZONE})?()()$", "$3|$2|$1|$4|$5|$6|$8|$7"),
    # 2024-01-01T10:00:00+02:00; 2024-01-01 10:00; 2024-01-01
    (rf"(?i)^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:T|\s+){CLOCK}\s*{ZONE})?()()$", "$1|$2|$3|$4|$5|$6|$8|$7"),
    # January 5, 2024 4:05 PM EST
    (rf"(?i)^(?:[a-z]{{3,9}}\.?,\s+)?([a-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{CLOCK}\s*(am|pm)?\s*{ZONE})?()$", "$3|$1|$2|$4|$5|$6|$7|$8"),
]


def published_at(c: Column) -> Column:
    """The moment a date string tells: RFC 822 with or without weekday, seconds or zone, ISO with or without clock or offset, and month-first.

    A date without zone is UTC, one without clock is midnight; fractions of seconds are cut. A
    blank, a form that is not known or a day that does not exist is null.
    """
    text = F.trim(F.regexp_replace(filled(c), r"(?U)\s+", " "))
    parts = F.split(F.coalesce(*(F.when(text.rlike(form), F.regexp_replace(text, form, order)) for form, order in FORMS)), r"\|", -1)
    return F.transform(F.array(parts), _moment)[0]  # a lambda, so that the parts are made once


def _moment(parts: Column) -> Column:
    whole = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    year, clock = whole(0), lambda i: F.when(F.get(parts, F.lit(i)) == "", 0).otherwise(whole(i))
    year = F.when(F.length(F.get(parts, F.lit(0))) > 2, year).when(year < 50, year + 2000).otherwise(year + 1900)
    names = F.create_map(*(F.lit(x) for n, m in enumerate(MONTHS, 1) for x in (m, n)))
    name = F.lower(F.substring(F.get(parts, F.lit(1)), 1, 3))
    month = F.coalesce(whole(1), F.try_element_at(names, name))
    half = F.lower(F.get(parts, F.lit(6)))
    hour = F.when(half == "pm", clock(3) % 12 + 12).when(half == "am", clock(3) % 12).otherwise(clock(3))
    zone = F.lower(F.get(parts, F.lit(7)))
    zones = F.create_map(*(F.lit(x) for z, h in ZONES.items() for x in (z, h * 60)))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    offset = F.when(digits != "", minutes).otherwise(F.coalesce(F.try_element_at(zones, zone), F.lit(0)))
    made = F.try_make_timestamp(year, month, whole(2), hour, clock(4), clock(5).cast("decimal(16,6)"), F.lit("UTC"))
    return F.when(F.abs(offset) <= 18 * 60, F.timestamp_add("MINUTE", -offset, made))


def utc_day(moment: Column) -> Column:
    """The day of a moment in UTC, whatever the session's time zone."""
    return F.to_date(F.to_utc_timestamp(moment, F.current_timezone()))
