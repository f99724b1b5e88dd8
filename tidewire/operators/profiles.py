"""What is looked for: keywords and term profiles of watchlist entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import compact, edged, filled, phrase

NO_TEXTS = "array<string>"


def company_tokens(company: Column) -> Column:
    """Words of a company name of three letters or digits at least, legal forms left out."""
    words = F.regexp_extract_all(F.lower(filled(company)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(rules.LEGAL_FORMS))


def keywords(ticker: Column, company: Column, extra: Column) -> Column:
    """Ticker, company and extra keywords in lower case, distinct and sorted; the company and extras if not empty."""
    more = F.filter(F.coalesce(extra, F.array().cast(NO_TEXTS)), lambda k: filled(k) != "")
    name = F.when(filled(company) != "", F.array(company)).otherwise(F.array().cast(NO_TEXTS))
    return F.array_sort(F.array_distinct(F.transform(F.concat(F.array(filled(ticker)), name, more), F.lower)))


def profiles(watchlist: DataFrame) -> DataFrame:
    """watchlist with its keywords to search (watch_keywords) and its identity, specific and generic terms."""
    name = phrase(F.col("company"))
    named = F.when(name != "", F.concat(F.array(name), company_tokens(name))).otherwise(F.array().cast(NO_TEXTS))
    identity = F.array_sort(F.array_distinct(F.concat(F.array(phrase(F.col("ticker"))), named)))
    extra = F.filter(F.transform(F.coalesce("keywords", F.array().cast(NO_TEXTS)), phrase), lambda k: k != "")
    generic = F.array(*map(F.lit, rules.GENERIC_TERMS))
    out = watchlist.withColumns({"watch_keywords": keywords(F.col("ticker"), F.col("company"), F.col("keywords")), "identity_terms": identity})
    context = F.array_except(extra, F.col("identity_terms"))
    return out.withColumns({"specific_terms": F.array_sort(F.array_except(context, generic)), "generic_terms": F.array_sort(F.array_intersect(context, generic))})


def needles(profiled: DataFrame) -> DataFrame:
    """What the join to articles carries: compact keywords, and each kind's terms with their edged form."""
    terms = lambda c: F.transform(c, lambda t: F.struct(t.alias("term"), edged(t).alias("edged"))).alias(c)
    short = F.array_distinct(F.filter(F.transform("watch_keywords", compact), lambda k: k != ""))
    return profiled.select("watch_ord", "ticker", short.alias("short_keywords"), *map(terms, ("identity_terms", "specific_terms", "generic_terms")))
