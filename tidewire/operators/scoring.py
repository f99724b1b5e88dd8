"""Relevance of an article to a watchlist entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import canonical_link, rounded, title_key
from .matching import edged_texts, matched


def prepared(articles: DataFrame) -> DataFrame:
    """What is known of an article whatever the entry: event, title flags, link and title key."""
    title = F.col("title")
    return rules.with_event(edged_texts(articles)).withColumns(
        {
            "__roundup": rules.is_roundup(title),
            "__context": rules.is_context(title),
            "canonical_link": canonical_link(F.col("link")),
            "title_key": title_key(title),
        }
    )


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with matched terms, relevance_score, rejection_reasons and accepted. Narrow: nothing moves."""
    out = pairs
    for kind in rules.POINTS:
        terms = F.col(f"{kind}_terms")
        out = out.withColumns({f"__{kind}_t": matched(terms, F.col("__title")), f"__{kind}_s": matched(terms, F.col("__summary"))})
    score: Column = F.lit(0.0)
    for kind, (title, summary) in rules.POINTS.items():
        score = score + F.size(f"__{kind}_t") * title + F.size(f"__{kind}_s") * summary
    source = F.lit(0.0)
    for key, points in rules.SOURCE_POINTS.items():
        source = F.when(F.col("source_key") == key, points).otherwise(source)
    score = score + source + F.when(F.col("__roundup"), rules.ROUNDUP_POINTS).otherwise(0.0)
    both = lambda k: F.array_sort(F.array_union(f"__{k}_t", f"__{k}_s"))
    out = out.withColumns({"relevance_score": rounded(score), **{f"matched_{k}": both(k) for k in rules.POINTS}})
    focus = (F.size("__identity_t") > 0) | (F.size("__specific_t") > 0)
    signal = (F.size("matched_identity") > 0) | (F.size("matched_specific") > 0)
    weak = F.col("source_key").isin(rules.WEAK_SOURCES) & ~focus & (F.size("matched_identity") < 2)
    reasons = {
        "broad_roundup_pattern": F.col("__roundup"),
        "low_relevance_score": F.col("relevance_score") < rules.ACCEPT,
        "no_company_specific_signal": ~signal,
        "no_title_focus": ~focus,
        "roundup_without_focus": F.col("__roundup") & ~focus,
        "weak_aggregator_match": weak,
    }
    listed = F.array_compact(F.array(*(F.when(c, name) for name, c in reasons.items())))
    out = out.withColumn("rejection_reasons", listed)
    # a round-up title alone does not reject
    return out.withColumn("accepted", F.size(F.array_remove("rejection_reasons", "broad_roundup_pattern")) == 0)
