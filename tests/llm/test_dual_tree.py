"""Ranked search against brute force, and that bounds prune."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import dual_tree


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    sized = [(i, c, sum(c.values())) for i, c in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in sized), sum(n for *_, n in sized)
    held = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
    out = Counter()
    for item, text in items:
        found = []
        for i, c, n in sized:
            m = 10 + (90 * n * n_docs) // n_terms if n else 0
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            found += [(-score, i)] if score > 0 else []
        out.update((item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k]) if item is not None)
    return out


def tables():
    random.seed(6)
    words = ["".join(random.choices("abcdé", k=random.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(random.choices(words, weights=range(1, 401), k=n))
    items = [(i, text(random.randint(1, 25))) for i in range(40)]
    docs = [(i, text(random.randint(1, 120)) + random.choice([".", "\n", "-X9", "ÀÉ"])) for i in range(300)]
    docs += [(400 + i, "one passage " + items[3][1].upper() + " of many copies") for i in range(120)]
    docs += [(700, None), (701, ""), (702, " .,-"), (703, "b" * 5000 + " " + text(30)), (704, text(20_000)), (5, docs[5][1]), (5, text(9)), (None, items[4][1])]
    items += [(50, None), (51, ""), (52, "zzzz qqqq"), (None, text(5)), (3, text(8)), (53, items[3][1])]
    return docs, items


def searched(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"Terms": F.lit("mine"), "n": F.lit(1), "score": F.lit(0)}).repartition(5)
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({"row": F.lit(1), "rank": F.lit(2)}).repartition(2)
    return Counter(tuple(r) for r in dual_tree.search(docs, items, **more).collect())


def test_against_brute_force(spark):
    docs, items = tables()
    assert searched(spark, docs, items) == by_hand(docs, items)


@pytest.mark.parametrize("small", ["passes", "leaves", "pieces"])
def test_small_bounds_change_nothing(spark, monkeypatch, small):
    docs, items = tables()
    if small == "leaves":
        monkeypatch.setattr(dual_tree, "LEAF", 3)
        monkeypatch.setattr(dual_tree, "LEAF_TERMS", 150)
        monkeypatch.setattr(dual_tree, "RUN_CELLS", 2000)
    got = searched(spark, docs, items, **({"per_pass": 120} if small == "passes" else {}))
    if small == "pieces":
        monkeypatch.setattr(dual_tree, "PIECE", 7)
        for _, text in docs[-12:]:
            assert [w.decode() for words in dual_tree.pieces(text or "") for w in words] == terms(text)
    assert got == by_hand(docs, items)


def test_empty_tables(spark):
    docs, items = tables()
    docs, items = docs[:5], items[:3]
    assert not searched(spark, [], items) and not searched(spark, docs, []) and not searched(spark, [(1, None)], items)
    assert not searched(spark, docs, [(1, None), (2, "!")])
    assert searched(spark, docs, items, k=2) == by_hand(docs, items, 2)


def test_bounds_rule_out_most_leaves():
    """Documents in groups of one vocabulary each: an item's search opens the leaves of few groups."""
    rng = np.random.default_rng(9)
    groups, each = 40, 30
    weights = rng.integers(500, 5000, groups * each)
    items = [np.sort(rng.choice(each, 6, replace=False) + g * each).astype(np.int32) for g in range(groups)]
    tree = dual_tree.ItemTree(items, weights)
    leaves, maxima = [], []
    for g in range(groups):
        for _ in range(4):
            rows = [(np.sort(rng.choice(each, 12, replace=False) + g * each).astype(np.int32), rng.integers(1, 10**6, 12).astype(np.int32)) for _ in range(8)]
            docs = np.arange(len(leaves) * 8, len(leaves) * 8 + 8)
            flat, grades = np.concatenate([t for t, _ in rows]), np.concatenate([x for _, x in rows])
            leaves.append(dual_tree.Leaf(docs.tobytes(), (np.arange(1, 9) * 12).astype(np.int32).tobytes(), flat.tobytes(), grades.tobytes()))
            top = np.unique(flat)
            maxima.append((top, np.array([grades[flat == t].max() for t in top], np.int32)))
    run = dual_tree.Run(maxima)
    none = np.zeros(groups, np.int64)
    opened = {tree.numbers[i]: at.tolist() for i, at, _ in run.open(tree.root, none)}
    assert {g: {a // 4 for a in at} for g, at in opened.items()} == {g: {g} for g in range(groups)}
    best = np.array([max(int(leaf.scores(node).max()) for leaf in leaves) for node in tree.leaves])
    tight = {tree.numbers[i]: at.tolist() for i, at, _ in run.open(tree.root, best)}
    assert sum(map(len, tight.values())) < sum(map(len, opened.values())) == 4 * groups  # of groups x groups x 4
    for i, node in enumerate(tree.leaves):  # the best document's leaf is never ruled out
        assert any(int(leaves[a].scores(node).max()) == best[i] for a in tight[tree.numbers[i]])
        at, bound = run.promising(node)
        assert bound >= int(leaves[at].scores(node).max())
