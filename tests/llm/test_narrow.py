"""Operators that read one text at a time, against the library or brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, language_id, licenses, sentencepieces
from tidewire.llm.common import BATCH_BYTES, append

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "\x00", "a", "▁", "é ½", "the " * 3000, "x" * 5000, "  lead", "trail  ", "\U0001f600 日本", "the the", "the the"]


CLASHES = ["spans", "items", "key", "at", "size", "w", "item_id", "decoded", "ids", "n_hit", "labels", "lang", "row"]


def frame(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # names that operators use for their own results
    return df.withColumns({"score": F.lit("mine"), "n_words": F.lit(7), "N_tokens": F.lit(True), "lang_pred": F.lit(None), **{c: F.lit("mine") for c in CLASHES}}) if extra else df


@pytest.fixture(scope="module")
def model():
    return sentencepieces.model_at(PIECES)


def test_pieces_equal_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    random.seed(4)
    texts = [t or "" for t in ODD] + [" " * n for n in range(40)] + ["aba" * 70, "=" * 200]
    for alphabet in (list("abc ▁  \n\té日\U0001f600") + ["the", "ing"], [chr(c) for c in range(32, 800)]):
        texts += ["".join(random.choices(alphabet, k=random.randint(0, 50))) for _ in range(400)]
    for t in texts:
        want = library.encode(t)
        got = np.frombuffer(b"".join(model.encode_words(model.words(t))), "<u4").tolist()
        assert got == want, t
        assert model.decode(np.array([1, *got, 2], "<u4").tobytes()) == library.decode([1, *want, 2])


def test_pieces_digests_and_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepieces.digests(frame(spark, ODD, True), PIECES, with_ids=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    again = sentencepieces.decode(sentencepieces.encode(frame(spark, ODD, True), PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in again)
    assert not sentencepieces.digests(frame(spark, []), PIECES).collect()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contaminated_by_hand(text, items):
    words = WORD.findall(lowered(text))
    hit, owners = set(), set()
    for item, t in items:
        w = WORD.findall(lowered(t))
        size = min(13, len(w))
        if item is None or not size:
            continue
        for i in range(len(w) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    owners.add(item)
    listed = ",".join(sorted(map(str, owners)))
    return len(words), len(hit), len(owners), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontaminate_against_brute_force(spark):
    random.seed(9)
    vocabulary = ["Ab", "b", "cé", "d1", "e"]
    text = lambda n: "".join(random.choice(vocabulary) + random.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(random.choice([2, 5, 13, 14, 30]))) for i in range(12)] + [(None, text(14)), (50, None), (51, "..."), (3, "zz b"), (60, "solo")]
    docs = ODD + [text(random.randint(0, 60)) for _ in range(40)] + [f"{text(20)} {items[k][1]} {text(400)}" for k in range(6)] + ["Solo"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [contaminated_by_hand(t, items) for t in docs]
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        rows = decontaminate.annotate(frame(spark, docs, True), bench, limit=limit).orderBy("doc_id").collect()
        assert [tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows] == want, limit
    kept = decontaminate.remove_documents(frame(spark, docs, True), bench)
    assert kept.columns == frame(spark, docs, True).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if not w[4]}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(spark, docs), bench).collect()}
    assert spans == {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(spark, docs, True), bench, limit=0).collect()}
    assert spans[0] is None and spans[len(docs) - 1] == "" and all(len(WORD.findall(spans[i] or "")) == w[0] - w[1] for i, w in enumerate(want))
    assert not decontaminate.annotate(frame(spark, docs), bench.limit(0)).where("contaminated").count()


def expression_by_hand(text):
    """(labels, freedom) by recursive descent, over the longest part from the left that is an expression."""
    tokens = re.findall(r"[()]|[A-Za-z0-9.+:-]+", text)
    known = lambda w: w.removesuffix("+") in licenses.FREEDOM or w in licenses.EXCEPTIONS or re.fullmatch(r"(?:licenseref|documentref)-.+|[a-z][a-z0-9.+-]*-[0-9][a-z0-9.+-]*", w)
    usable, depth, after = [], 0, False
    for i, t in enumerate(tokens):
        w = t.lower()
        if w == "(" and not after:
            depth += 1
        elif w == ")" and after and depth:
            depth -= 1
        elif w in ("and", "or", "with") and after:
            after = False
        elif w not in ("(", ")", "and", "or", "with") and not after and w.rstrip(".:") and (known(w.rstrip(".:")) or i == 0):
            w, after = w.rstrip(".:"), True
        else:
            break
        usable.append(w)
    while usable and usable[-1] in ("(", "and", "or", "with"):
        depth -= usable.pop() == "("
    usable += [")"] * depth
    at = 0

    def parse(level):
        nonlocal at
        if level == 3:
            w = usable[at]
            at += 1
            if w != "(":
                return {w}, licenses.freedom(w)
            out = parse(0)
            at += 1
            return out
        op = ("or", "and", "with")[level]
        left = parse(level + 1)
        while at < len(usable) and usable[at] == op:
            at += 1
            right = parse(level + 1)
            if op == "with":
                name = next(iter(right[0])) if len(right[0]) == 1 else "exception"
                left = {f"{x} with {name}" for x in left[0]}, left[1] + (1 - left[1]) / 2 if name in licenses.EXCEPTIONS else left[1]
            else:
                left = left[0] | right[0], (max if op == "or" else min)(left[1], right[1])
        return left

    return parse(0) if usable else (set(), 1.0)


def licences_by_hand(text):
    words = WORD.findall(lowered(text))
    line = f" {' '.join(words)} "
    labels = {label for p, label in {**licenses.BASE, **licenses.NOTICES}.items() if f" {p} " in line}
    rights = [licenses.freedom(x) for x in labels]
    spans = list(WORD.finditer(lowered(text)))
    for k in range(len(words) - 2):
        m = words[k : k + 3] == ["spdx", "license", "identifier"] and re.compile(r"[ \t]*:[ \t]*([A-Za-z0-9.+:() \t-]+)").match(text, spans[k + 2].end())
        if m:
            more, free = expression_by_hand(m[1])
            labels |= more
            rights.append(free)
    return ",".join(sorted(labels)), min(rights, default=0.0)


def test_license_scan(spark):
    texts = ODD + [
        "All rights reserved.",
        "x CC BY-NC 4.0 cc by cc by",
        "the GNU General Public License, version 3.",
        "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 more words",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
        "SPDX-License-Identifier: AND (",
        "SPDX-License-Identifier: MIT and other text", "spdx-license-identifier: BUSL-1.1", "SPDX-License-Identifier: Foo or bar", "SPDX-License-Identifier: LicenseRef-Internal OR MIT.",
        "SPDX-License-Identifier: ((MIT) OR (GPL-3.0-only AND MPL-2.0)) AND CC-BY-NC-4.0\nSPDX-License-Identifier: 0BSD", "(SPDX-License-Identifier: MIT) more", "SPDX-License-Identifier: MIT WITH unknown-1 OR",
        "apache license version 2.0 and no part of this publication may be reproduced", "cc by " * 30_000,
        "SPDX-License-Identifier : MIT", "é spdx license\nidentifier\t: ISC or 0BSD, SPDX-License-Identifier MIT", "SPDX_License_Identifier:MIT SPDX-License-Identifier:", "xSPDX-License-Identifier: MIT",
    ]
    random.seed(3)
    names = ["MIT", "GPL-2.0-only", "MPL-2.0", "Nope-9", "CC-BY-NC-4.0", "LicenseRef-x"]
    for _ in range(80):
        parts = [random.choice(["(", ""]) + random.choice(names) + random.choice([")", ""]) + random.choice([" AND ", " OR ", " WITH Classpath-exception-2.0 or ", " "]) for _ in range(random.randint(1, 5))]
        texts.append("x SPDX-License-Identifier: " + "".join(parts) + random.choice(["", "prose here", "\nmit license"]))
    rows = {r["doc_id"]: r for r in licenses.annotate(frame(spark, texts, True)).collect()}
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for i, t in enumerate(texts):
        words = WORD.findall(lowered(t))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["labels"], r["score"]) == licences_by_hand(t), t
    assert rows[len(ODD) + 3]["labels"] == "apache-2.0,gpl-2.0-only,mit" and rows[len(ODD) + 3]["score"] == 1.0
    assert rows[len(ODD) + 4]["labels"] == "gpl-2.0-only with classpath-exception-2.0" and rows[len(ODD) + 4]["score"] == 0.625
    assert licenses.evaluate("MIT AND GPL-3.0-only OR BSD-3-Clause") == ({"mit", "gpl-3.0-only", "bsd-3-clause"}, 1.0)
    assert licenses.evaluate("MIT AND (GPL-3.0-only OR MPL-2.0)")[1] == 0.5


def test_very_long_license_expressions():
    import time

    found, began = licenses.automaton(), time.thread_time()
    names = [f"LicenseRef-{i}" for i in range(60_000)]
    long = "SPDX-License-Identifier: " + " or ".join(names)
    deep = "SPDX-License-Identifier: " + "(" * 100_000 + "MIT" + ")" * 100_000 + " AND ISC"
    many = "SPDX-License-Identifier: MIT\n" * 30_000
    assert len(long) > 1_000_000 and licenses.scan(long, found)[5].count(",") == len(names) - 1
    assert licenses.scan(deep, found)[5:] == ("isc,mit", 1.0) and licenses.scan(many, found)[5:] == ("mit", 1.0)
    assert time.thread_time() - began < 5


def test_language_id(spark):
    random.seed(2)
    languages = {"aa": "ba de fi go ku la".split(), "bb": "sch tz üb ver keit ung".split(), "cc": "ción ñas que mos ez ia".split()}
    make = lambda k, n: " ".join("".join(random.choices(languages[k], k=3)) for _ in range(n))
    rows = [(i, make(k, random.randint(8, 60)), k) for i, k in enumerate(random.choices(list(languages), k=240))]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(2000, None, "aa"), (2001, "", "bb"), (2002, "½ 12", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.fit(docs.where(~language_id.held_out()))
    assert trees.labels == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.predict(docs.withColumn("score", F.lit("mine")), trees).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] < 1000 and __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2]
    assert held and sum(got[i]["lang_pred"] == k for i, _, k in held) >= 0.97 * len(held)
    for i, t, _ in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
    assert language_id.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def ppm_by_hand(texts, order=3):
    """Code length in bits of a line under trees of the texts: method C with exclusions."""
    tree = {}
    for t in texts:
        line = bytes(order) + t
        for i in range(order, len(line)):
            for n in range(order + 1):
                tree.setdefault(line[i - n : i], {}).setdefault(line[i], 0)
                tree[line[i - n : i]][line[i]] += 1

    def bits(line):
        line, out = bytes(order) + line, 0.0
        for i in range(order, len(line)):
            gone = set()
            for n in range(order, -1, -1):
                here = {c: k for c, k in tree.get(line[i - n : i], {}).items() if c not in gone}
                if not here:
                    continue
                total = sum(here.values()) + len(here)
                if line[i] in here:
                    out -= np.log2(here[line[i]] / total)
                    break
                out -= np.log2(len(here) / total)
                gone |= set(here)
            else:
                out += np.log2(256 - len(gone))
        return out

    return bits


def test_language_id_against_ppm_by_hand(spark):
    random.seed(6)
    words = {"a": "ab ba aab é".split(), "b": "ab cd dc ß".split(), "c": "zz ab".split()}
    train = [(i, " ".join(random.choices(words[k], k=random.randint(1, 9))), k) for i, k in enumerate("aabbccaabbc")]
    trees = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    hand = [ppm_by_hand([language_id.letters_of(t) for _, t, k in train if k == label]) for label in trees.labels]
    tests = [t for _, t, _ in train] + ["ab", "q", "ab cd q é", "日本 ab", "dc " * 50, *(" ".join(random.choices(sum(words.values(), []), k=6)) for _ in range(30))]
    want = np.array([[h(language_id.letters_of(t)) for h in hand] for t in tests])
    assert np.allclose(trees.score([language_id.letters_of(t) for t in tests]), want, rtol=1e-5)
    got = language_id.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), trees).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [trees.labels[i] for i in want.argmin(axis=1)]
    assert np.allclose([r["score"] for r in got], 1 / np.exp2(want.min(axis=1)[:, None] - want).sum(axis=1), rtol=1e-3)


def test_code_lengths_are_a_distribution(spark):
    docs = spark.createDataFrame([(i, "abcab cab " * (i + 1), "x") for i in range(4)], "doc_id long, text string, lang string")
    trees = language_id.fit(docs)
    share = np.exp2(-trees.bits.reshape(-1, trees.width))
    share[:, 0] *= trees.unseen  # class 0 stands for each byte never seen
    assert np.allclose(share.sum(axis=1), 1, atol=1e-4)


def test_arrow_batches_are_bounded_by_bytes(spark):
    """A task gets long texts a few megabytes at a time, with those that append's columns go on to."""
    docs = spark.range(0, 4_000, 1, 1).select("id", F.repeat(F.lit("abcdefgh "), 1_000).alias("text"))
    made = append(docs, "text", "n long", lambda: lambda texts: [list(map(len, texts))])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = made.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 4_000 and max(r["bytes"] for r in got) <= 1.1 * BATCH_BYTES
    assert made.agg(F.sum("n")).first()[0] == 36_000_000
