"""Stupid-backoff scores against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.llm import lm_scoring


def by_hand(texts, order, least=2):
    split = [["<"] * (order - 1) + re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) + [">"] for t in texts]
    count = Counter(tuple(s[i : i + n]) for s in split for n in range(1, order + 1) for i in range(len(s) - n + 1))
    total = sum(c for g, c in count.items() if len(g) == 1 and g != ("<",))

    def v(g):
        if len(g) == 1:
            return math.log10(count[g] / total)
        return math.log10(count[g] / count[g[:-1]]) if count[g] >= least else math.log10(0.4) + v(g[1:])

    out = []
    for s in split:
        grams = [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]
        off = sum(order > 1 and count[g] < least for g in grams)
        out.append((len(grams), off, sum(map(v, grams)) / len(grams)))
    return out


@pytest.mark.parametrize(("order", "hot"), [(2, lm_scoring.HOT), (2, 5), (3, 40), (3, 0)])
def test_scores_against_brute_force(spark, order, hot):
    random.seed(17)
    vocabulary = "The THE of é1 É1 and or a b c d ing st".split()
    texts = [None, "", "...", "solo", "the the the", *(" ".join(random.choices(vocabulary, weights=range(13, 0, -1), k=random.randint(1, 60))) for _ in range(80)), "long one " * 20_000]
    ids = [None if i == 3 else i // 2 * 2 if i > 60 else i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumns({"n": F.lit(1), "doc": F.lit("x"), "k": F.lit(2)}).repartition(3)
    got = lm_scoring.annotate(docs, order=order, hot=hot).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2], round(r[3], 5))
    want = sorted(key((i, *x)) for i, x in zip(ids, by_hand(texts, order)))
    for g, w in zip(sorted(map(key, got)), want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 3e-5


def test_lone_and_no_document(spark):
    docs = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    row = lm_scoring.annotate(docs).first()
    assert (row["n_tokens"], row["n_backoff"]) == (5, 3)
    assert lm_scoring.annotate(docs.limit(0)).count() == 0


def test_without_a_cut_every_ngram_is_in_the_model(spark):
    texts = ["a b a b", "once upon", None, "a once b"]
    got = lm_scoring.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_count=1).orderBy("doc_id").collect()
    for g, w in zip(got, by_hand(texts, 2, least=1), strict=True):
        assert (g["n_tokens"], g["n_backoff"]) == (w[0], 0) == w[:2] and abs(g["score"] - w[2]) < 3e-5
