"""Anchors of HTML pages, read by the standard parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that never hold others.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SUMMARY_CHARS = 400
#: Pages whose anchors a task holds at once.
PAGES = 64


class AnchorReader(HTMLParser):
    """Collects (href, text, text of the parent, elements around) of every anchor, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = [{"tag": "", "parts": []}]
        self.anchors: list[tuple[str, list[str], list[str], set[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        node = {"tag": tag, "parts": []}
        if tag == "a":
            self.anchors.append((dict(attrs).get("href") or "", node["parts"], self.open[-1]["parts"], {n["tag"] for n in self.open}))
        self.open.append(node)

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i]["tag"] == tag), 0)
        while depth and len(self.open) > depth:
            done = self.open.pop()
            self.open[-1]["parts"].extend(done["parts"])

    def handle_data(self, data):
        self.open[-1]["parts"].append(data.strip())

    def finish(self) -> list[tuple[str, str, str, set[str]]]:
        self.close()
        while len(self.open) > 1:
            done = self.open.pop()
            self.open[-1]["parts"].extend(done["parts"])
        line = lambda parts: re.sub(r"\s+", " ", " ".join(filter(None, parts))).strip()
        return [(href, line(own), line(parent), around) for href, own, parent, around in self.anchors]


def picked(href: str, around: set[str], selectors: list[tuple[list[str], str]]) -> int:
    """Place of the first selector (elements around, part of the href) that takes an anchor; -1 for none, 0 without selectors."""
    return next((i for i, (tags, part) in enumerate(selectors) if part in href and around.issuperset(tags)), -1) if selectors else 0


def anchors(pages: DataFrame, id_col: str, html_col: str, homepage_col: str, selectors: list[tuple[list[str], str]] = ()) -> DataFrame:
    """(id, choice, position, link, title, summary) of every anchor with a link, links resolved to the homepage.

    With selectors only the anchors that one takes; choice is the first such selector's place,
    and the order of anchors is by choice, then by position.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + PAGES] for whole in batches for i in range(0, len(whole), PAGES)):
            rows = []
            for page, markup, homepage in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], pdf.iloc[:, 2]):
                reader = AnchorReader()
                reader.feed(markup or "")
                for i, (href, title, parent, around) in enumerate(reader.finish()):
                    choice = picked(href, around, selectors)
                    if href and choice >= 0:
                        rows.append((page, choice, i, urljoin(homepage or "", href), title, "" if parent == title else parent[:SUMMARY_CHARS]))
            yield pd.DataFrame(rows, columns=["page", "choice", "position", "link", "title", "summary"])

    return pages.select(id_col, html_col, homepage_col).mapInPandas(run, "page long, choice int, position int, link string, title string, summary string")
