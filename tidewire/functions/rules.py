"""Fixed rules of relevance: word lists, patterns, weights, and the columns made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that say little about one company.
GENERIC_TERMS = ["ai", "gpu", "chip", "chips", "stock", "stocks", "market", "markets", "earnings", "shares", "price", "target"]

# Legal forms left out of company names.
LEGAL_FORMS = ["inc", "inc.", "corp", "corp.", "corporation", "co", "co.", "company", "group", "holdings", "ltd", "ltd.", "plc"]

# Titles of round-ups.
ROUNDUP = [
    r"\btop stories\b",
    r"\btop midday stories\b",
    r"\bstock market today\b",
    r"\blive coverage\b",
    r"\bmost active stocks\b",
    r"\banalyst blog\b",
    r"\b\d+\s+out of\s+\d+\b",
    r"\btop\s+\d+\b",
    r"\b\d+\s+(stocks|companies|etfs|funds)\b",
]

# Titles that give context rather than news.
CONTEXT = [
    r"\bvs\b",
    r"\bshare gains lead dow\b",
    r"\bposts biggest gain\b",
    r"\bmagnificent seven\b",
    r"\bbig tech etf\b",
    r"\binvestor backs startup\b",
    r"\bstock portfolio\b",
    r"\brally powers tech gains\b",
    r"\brecord highs\b",
    r"\bdow jones hits\b",
    r"\bpower market indexes higher\b",
]

# Event types in the order they are tried, their weights and patterns.
EVENTS = [
    ("executive_change", 1.0, [r"\bnew ceo\b", r"\bnames new ceo\b", r"\bappoints\b", r"\bsteps? down\b", r"\bchief executive\b", r"\bchairman\b"]),
    (
        "analyst_rating_or_target",
        0.9,
        [r"\bprice target\b", r"\bhikes? .*target\b", r"\btarget to\b", r"\bupgrade\b", r"\bdowngrade\b", r"\bmore cautious\b", r"\boutperform\b", r"\boverweight\b", r"\banalyst\b"],
    ),
    ("earnings_or_guidance", 1.0, [r"\bearnings\b", r"\bguidance\b", r"\bquarter\b", r"\bq[1-4]\b", r"\bbeat-and-raise\b", r"\boutlook\b", r"\brevenue\b"]),
    (
        "regulatory_or_geopolitical",
        0.95,
        [r"\bapproved?\b", r"\bapproval\b", r"\bchina\b", r"\btariffs?\b", r"\bexport controls?\b", r"\btrump\b", r"\bxi\b", r"\bgovernment\b", r"\bgeopolitical\b"],
    ),
    (
        "product_or_strategy",
        0.85,
        [r"\blaunch(?:es|ed)?\b", r"\badopt\b", r"\bcollaboration\b", r"\bpartner(?:s|ship)?\b", r"\bexpand collaboration\b", r"\bchip production\b", r"\bdeal\b", r"\bproduction on track\b", r"\bstreaming standard\b", r"\bdemand stays strong\b"],
    ),
    ("market_reaction", 0.7, [r"\bstock hits\b", r"\bstock extends\b", r"\bvaluation\b", r"\bshare gains\b", r"\bstock surges\b", r"\bwinning streak\b", r"\brecord peak\b", r"\brecord\b"]),
    ("comparison_or_context", 0.5, [r"\bvs\b", r"\brevenge on\b", r"\bdominated market\b", r"\bweek ahead\b", r"\bin focus\b", r"\bother .* names\b"]),
]
# The type and weight of everything else.
OTHER_EVENT = ("general_company_focus", 0.75)

# Points of a matched term in the title and in the summary.
POINTS = {"identity": (7.0, 4.0), "specific": (4.0, 2.0), "generic": (1.0, 0.5)}
# Points of a source, and of a round-up.
SOURCE_POINTS = {"yahoo_finance": 2.0, "prnewswire": 1.0, "globenewswire": 1.0, "accessnewswire": 1.0, "finviz": -1.0}
ROUNDUP_POINTS = -6.0
# Least scores to be accepted, to be related by summary, to be reviewed.
ACCEPT, RELATED, REVIEW = 7.0, 8.0, 4.0
# Sources whose matches need more than a summary.
WEAK_SOURCES = ["finviz", "marketwatch_topstories", "marketwatch_marketpulse", "sec_press_releases"]
# Growth of the signal with each further source row, bounds of overall sentiment.
COVERAGE_STEP = 0.15
SENTIMENT_BOUND = 0.15


def any_of(c: Column, patterns: list[str]) -> Column:
    r"""Whether a pattern occurs. All begin and end at a word's edge, so the edge is tried once a place.

    Text of ASCII only (as many bytes as characters) goes without Unicode classes, which are slow.
    """
    inner = "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in patterns)
    one = rf"\b(?:{inner})\b"
    return F.when(F.octet_length(c) == F.length(c), c.rlike(f"(?i){one}")).otherwise(c.rlike(f"(?iU){one}"))


def is_roundup(title: Column) -> Column:
    return any_of(title, ROUNDUP)


def is_context(title: Column) -> Column:
    return any_of(title, CONTEXT)


def event_place(title: Column, summary: Column) -> Column:
    """Place in EVENTS of the first type with a pattern in the title, else in the summary; after the last for none."""
    out = F.when(F.lit(False), len(EVENTS))
    for text in (title, summary):
        for i, (_, _, patterns) in enumerate(EVENTS):
            out = out.when(any_of(text, patterns), i)
    return out.otherwise(len(EVENTS))


def event_name(place: Column) -> Column:
    return F.get(F.array(*(F.lit(e[0]) for e in [*EVENTS, OTHER_EVENT])), place)


def event_weight(place: Column) -> Column:
    return F.get(F.array(*(F.lit(e[1]) for e in [*EVENTS, OTHER_EVENT])), place)


def with_event(df: DataFrame) -> DataFrame:
    """df with event_type and event_weight; the patterns are tried once a row."""
    placed = df.withColumn("__event", event_place(F.col("title"), F.col("summary")))
    return placed.withColumns({"event_type": event_name(F.col("__event")), "event_weight": event_weight(F.col("__event"))}).drop("__event")
