"""Hard negatives against all pairs by hand."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def by_hand(rows, every, positives=5, negatives=5, most=2**63 - 1):
    clip = lambda x: max(-most, min(most, x))
    whole = lambda x: max(-(2**63), min(most, math.floor(256 * float(np.float32(x)))))
    good = [(i, y, list(map(whole, v))) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, y, v) in enumerate(good):
        if i % every:
            continue
        scored = [(-clip(sum(p * q for p, q in zip(v, w))), j, z, b) for b, (j, z, w) in enumerate(good) if len(w) == len(v)]
        same = sorted((s, j) for s, j, z, b in scored if z == y and b != a)[:positives]
        other = sorted((s, j) for s, j, z, b in scored if z != y)
        for s, j in same:
            fit = [(t, k) for t, k in other if 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out.update((i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit))
    return out


def mined(vectors, every, **more):
    return Counter(tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("per_pass", [10_000, 7])
def test_against_all_pairs(spark, per_pass):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    rows += [(400 + i, i % 2, [0.5] * 8) for i in range(60)]  # a common vector under two labels
    rows += [(10, 2, rows[10][2]), (10, 3, rows[10][2]), (500, None, [1.0] * 8), (None, 1, [1.0] * 8), (510, 1, None), (520, 1, []), (530, 1, [None] * 8), (540, 1, [float("nan")] * 8), (550, 1, [float("inf")] * 8)]
    rows += [(560, 1, [0.0] * 8), (570, 1, [1.0, 2.0]), (571, 1, [2.0, 2.0]), (572, 2, [1.5, 2.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("mine"), "Score": F.lit(1), "slot": F.lit(2)}).repartition(5)
    want = by_hand(rows, 10)
    assert sum(want.values()) > 300 and mined(vectors, 10, per_pass=per_pass) == want


def test_windows_that_overlap_share_slots(spark):
    # one anchor, whose positives score 100 to 60, and negatives all along
    rows = [(0, 0, [1.0, 0.0])] + [(i, 0, [float(x) / 256, 0.0]) for i, x in enumerate((100, 90, 90, 70, 60, 10), 1)]
    rows += [(100 + x, 1 + x % 3, [float(x) / 256, 1.0]) for x in range(40, 120)]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3), 1000)
    assert got == by_hand(rows, 1000) and {r[4] for r in got} == {25600, 23040, 17920, 15360}


def test_huge_components_ties_and_empty_tables(spark):
    rows = [(i, i % 2, [3e38 if i % 3 else -3e38, float(i % 5), 1.0]) for i in range(40)] + [(100 + i, i % 3, [1e15, -1e15, float(i)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    assert mined(vectors, 10) == by_hand(rows, 10)
    assert mined(vectors.limit(0), 10) == Counter() and mined(vectors, 1000) == by_hand(rows, 1000)
    alone = spark.createDataFrame([(0, 1, [1.0, 1.0]), (1, 2, [1.0, 1.0])], SCHEMA)
    assert mined(alone, 10) == Counter()  # no positive, so no window
