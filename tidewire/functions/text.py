"""Column functions on text, all on the JVM but for rare character references; a null text counts as ''."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EDGE = "\x01"
#: References that are replaced in place, the ampersand last; a text with any other goes through html.unescape in Arrow batches.
NAMED = {"&quot;": '"', "&apos;": "'", "&copy;": "©", "&middot;": "·", "&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
OTHER_REFERENCE = f"&(?!(?:{'|'.join(n[1:] for n in NAMED)}))[#A-Za-z]"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(filled(c), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else html.unescape(t))


def unescaped(c: Column) -> Column:
    """Character references resolved; only texts with one that is not in NAMED are sent to Python, of others a null."""
    plain = filled(c)
    for name, char in NAMED.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.coalesce(_unescape(F.when(filled(c).rlike(OTHER_REFERENCE), c)), plain)


def without_markup(c: Column) -> Column:
    """Tags to spaces, then references resolved (an escaped tag survives), then squeezed."""
    return squeezed(unescaped(F.regexp_replace(filled(c), "<[^>]+>", " ")))


def headline_text(c: Column) -> Column:
    """References resolved and squeezed; tags stay."""
    return squeezed(unescaped(c))


def first_filled(*cs: Column) -> Column:
    """The first of cs that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def article_text(title: Column, summary: Column) -> Column:
    return F.concat_ws(". ", F.nullif(filled(title), F.lit("")), F.nullif(filled(summary), F.lit("")))


def phrase(c: Column) -> Column:
    return squeezed(F.lower(filled(c)))


def spaced(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "")


title_key = spaced


def edged(c: Column) -> Column:
    """Text in which contains(edged(text), edged(term)) says that the term stands there as a whole.

    Every character but a-z and 0-9 is set between edges, white space runs are one space; so a
    term matches where neither neighbour is a letter or digit, whatever the white space.
    """
    one = F.regexp_replace(F.lower(filled(c)), r"(?U)\s+", " ")
    return F.concat(F.lit(EDGE), F.regexp_replace(one, "([^a-z0-9])", f"{EDGE}$1{EDGE}"), F.lit(EDGE))


LINK_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


#: What may stand before a path: a scheme, an authority.
LINK_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?"
CONTROLS = "".join(map(chr, range(0x21)))


def canonical_link(c: Column) -> Column:
    """Scheme and authority in lower case, no query or fragment, no slash at the end; an empty path is /.

    Each part is made once a row: a link is bound to a name, then its head is.
    """
    link = F.ltrim(F.translate(filled(c), "\t\r\n", ""), F.lit(CONTROLS))
    bare = F.substring_index(F.substring_index(link, "?", 1), "#", 1)

    def of(link: Column, head: Column) -> Column:
        path = F.rtrim(F.substring(link, F.length(head) + 1, F.length(link)), F.lit("/"))
        named = F.when(head.endswith("//"), F.substring(head, F.lit(1), F.length(head) - 2)).otherwise(head)  # an empty authority is none
        return F.concat(F.lower(named), F.when(path == "", "/").otherwise(path))

    out = F.get(F.transform(F.array(bare), lambda x: F.get(F.transform(F.array(F.regexp_extract(x, LINK_HEAD, 0)), lambda h: of(x, h)), F.lit(0))), F.lit(0))
    return F.when(filled(c) == "", "").otherwise(out)


def resolved_link(href: Column, homepage: Column) -> Column:
    """An absolute link as it is, `//host` with the homepage's scheme, `/path` with its host; else below its last folder."""
    h = F.trim(filled(href))
    scheme, host = F.regexp_extract(homepage, LINK_PARTS, 1), F.regexp_extract(homepage, LINK_PARTS, 2)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.concat(root, first_filled(F.regexp_extract(F.regexp_extract(homepage, LINK_PARTS, 3), "^(.*/)", 1), F.lit("/")))
    return (
        F.when(h == "", homepage)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(folder, h))
    )


def page_title(markup: Column) -> Column:
    return without_markup(F.regexp_extract(filled(markup), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(markup: Column) -> Column:
    """The text of a page without what scripts and styles hold."""
    return without_markup(F.regexp_replace(filled(markup), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "))


# Menu labels that are no headlines.
MENU_LABELS = ["", "search", "log in", "login", "contact", "learn more", "view all", "read more", "request a demo", "get started", "newsroom", "home"]
# Bounds of a headline's length and its least number of spaces.
HEADLINE_MIN, HEADLINE_MAX, HEADLINE_SPACES = 18, 260, 2


def is_headline(title: Column) -> Column:
    """Whether a squeezed title is plausible as a headline."""
    return F.length(title).between(HEADLINE_MIN, HEADLINE_MAX) & ~F.lower(title).isin(MENU_LABELS) & (F.size(F.split(title, " ", -1)) > HEADLINE_SPACES)


def rounded(c: Column) -> Column:
    """To two decimals by the exact binary value, half to even."""
    return F.call_function("format_number", c, F.lit("0.00")).cast("double")
