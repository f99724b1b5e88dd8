"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a
shunting-yard parser evaluates the expressions that follow the tags.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; a phrase occurs where
its words stand consecutively. The base phrases give n_base, first_word, last_word and
base_labels; the other notices and the tags add labels.

score: how freely the text may be used by its own statements. 1: only permissive ones, 0.5:
weak copyleft, 0.25: strong copyleft, 0.1: non-commercial or no-derivative terms, 0.05: an
identifier that is not in the list, 0: all rights reserved or no statement. Statements count
together (the least free), OR takes the freer side, AND the less free one, WITH (an exception of
the list) frees its licence by half of what is missing; an unknown exception frees nothing.

A tag is its three words, whatever stands between them; its expression begins behind the colon that
follows the last one, with any space around it. An expression reads identifiers of the list, LicenseRef- and DocumentRef- names, names with a
version (letters, a hyphen, then a digit) and, directly behind the tag, any name; it ends
before anything else, so prose behind it is none of it.

Defined results: a null or empty text has no words and no labels (empty strings), null
first_word and last_word, score 0; rows are independent; a malformed expression keeps the
identifiers before the fault; columns with the names of results are replaced by them.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import append
from .decontaminate import TO_WORDS

FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "public domain": "public-domain",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "proprietary and confidential": "proprietary",
    "no part of this publication may be reproduced": "reserved",
}
TAG = "spdx license identifier"
# Identifiers of licences, by how free they are.
PERMISSIVE = """0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC0-1.0 curl ECL-2.0 FTL
HPND ICU IJG ISC Libpng MIT MIT-0 MS-PL MulanPSL-2.0 NCSA NTP OFL-1.1 OpenSSL PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0
TCL Unicode-3.0 Unlicense UPL-1.0 W3C WTFPL X11 Zlib ZPL-2.1""".lower().split()
WEAK = """CDDL-1.0 CDDL-1.1 CPL-1.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-RL""".lower().split()
STRONG = """AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 GFDL-1.2-only GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later OSL-3.0 ODbL-1.0""".lower().split()
RESTRICTED = "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0".lower().split()
# Exceptions.
EXCEPTIONS = """Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1
Linux-syscall-note LLVM-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 u-boot-exception-2.0 WxWindows-exception-3.1""".lower().split()
#: Labels of notices, by how free they are.
LOOSE = {"cc-by": 1.0, "public-domain": 1.0, "apache": 1.0, "bsd": 1.0, "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "gpl": 0.25, "agpl": 0.25, "cc-by-sa": 0.25, "gpl-2.0": 0.25, "gpl-3.0": 0.25}
LOOSE |= {"cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.1, "reserved": 0.0, "proprietary": 0.0}
UNKNOWN = 0.05
FREEDOM = {**dict.fromkeys(PERMISSIVE, 1.0), **dict.fromkeys(WEAK, 0.5), **dict.fromkeys(STRONG, 0.25), **dict.fromkeys(RESTRICTED, 0.1), **LOOSE}
#: What follows the words of a tag.
EXPRESSION = re.compile(rb"[ \t]*:[ \t]*([A-Za-z0-9.+:() \t-]+)")
NAMED = re.compile(r"(?:licenseref|documentref)-.+|[a-z][a-z0-9.+-]*-[0-9][a-z0-9.+-]*")
BINDS = {"with": 3, "and": 2, "or": 1}


def freedom(label: str) -> float:
    return FREEDOM.get(label.removesuffix("+"), UNKNOWN)


def _is_name(word: str) -> bool:
    return word.removesuffix("+") in FREEDOM or word in EXCEPTIONS or bool(NAMED.fullmatch(word))


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and freedom of an and/or/with expression, by two stacks (shunting yard)."""
    values: list[tuple[set[str], float]] = []
    operators: list[str] = []

    def apply() -> None:
        op = operators.pop()
        if op == "(" or len(values) < 2:
            return
        (right, r), (left, v) = values.pop(), values.pop()
        if op == "with":
            (name,) = right if len(right) == 1 else ("exception",)
            values.append(({f"{x} with {name}" for x in left}, v + (1 - v) / 2 if name in EXCEPTIONS else v))
        else:
            small, large = sorted((left, right), key=len)
            large |= small  # neither is used again, so a long expression takes linear time
            values.append((large, max(v, r) if op == "or" else min(v, r)))

    after_value, open_, parens = False, 0, 0  # open_: operators since the last value
    for i, token in enumerate(re.findall(r"[()]|[A-Za-z0-9.+:-]+", expression)):
        word = token.lower()
        if word == "(":
            if after_value:
                break
            operators.append(word)
            open_ += 1
            parens += 1
        elif word == ")":
            if not after_value or not parens:
                break
            while operators[-1] != "(":
                apply()
            operators.pop()
            parens -= 1
        elif word in BINDS:
            if not after_value:
                break
            while operators and BINDS.get(operators[-1], 0) >= BINDS[word]:
                apply()
            operators.append(word)
            after_value, open_ = False, 1
        else:
            name = word.rstrip(".:")
            if after_value or not (name and (_is_name(name) or i == 0)):
                break  # what follows is prose
            values.append(({name}, freedom(name)))
            after_value, open_ = True, 0
    del operators[len(operators) - open_ :]  # nothing stands behind them
    while operators:
        apply()
    return values[0] if values else (set(), 1.0)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, found: ahocorasick.Automaton) -> tuple:
    """The values of FIELDS for one text."""
    raw = text.encode()
    words = raw.translate(TO_WORDS).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    base, starts, labels, tags = set(), [], set(), []
    for end, phrase in found.iter(line):
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        if phrase == TAG:
            tags.append(end - 1)
    if starts or tags:  # from places in the line to words
        place = np.cumsum([0, *(len(w) + 1 for w in words)])
        starts = np.searchsorted(place, starts).tolist()
    rights = [freedom(x) for x in base | labels]
    if tags:  # from the tag's last word to the place behind it in the text
        ends = [m.end() for m in re.finditer(rb"[^ ]+", raw.translate(TO_WORDS))]
        for last in (np.searchsorted(place, tags) - 1).tolist():
            if m := EXPRESSION.match(raw, ends[last]):
                more, free = evaluate(m[1].decode())
                labels |= more
                rights.append(free)
    labels |= base
    score = min(rights) if rights else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of FIELDS; nothing is shuffled."""

    def start():
        found = automaton()
        return lambda texts: [list(c) for c in zip(*(scan(t, found) for t in texts))]

    return append(docs, text_col, FIELDS, start)
