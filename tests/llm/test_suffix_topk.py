"""Repeated passages and exact search, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import exact_topk, suffix_dedup

from .brute import removed_by_hand


def passages():
    random.seed(12)
    words = ["the", "lé", "ond", "a", "ing", "zz"]
    text = lambda n: "".join(random.choice(words) + random.choice("  .\n") for _ in range(n))
    shared = [text(n) for n in (30, 60, 90, 150)]
    texts = [None, "", "short", "a" * 199, "b" * 200, "b" * 199 + "é", "c" * 450, "xyz" * 300, text(400)]
    for _ in range(60):
        parts = [text(random.randint(0, 40))]
        for _ in range(random.randint(0, 3)):
            p = random.choice(shared)
            if random.random() < 0.4:
                i = random.randrange(len(p))
                p = p[:i] + "#" + p[i + 1 :]
            parts += [p[random.randint(0, 20) :], text(random.randint(0, 30))]
        texts.append("".join(parts))
    return texts + texts[20:24]


@pytest.mark.parametrize("limit", [suffix_dedup.BROADCAST_BYTES, 0])
def test_repeats_against_brute_force(spark, limit):
    texts = passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc", F.lit("mine")).repartition(3)
    got = suffix_dedup.annotate(docs, limit=limit).drop("spans").collect()
    want = removed_by_hand(texts)
    assert sum(w[1] for w in want) > 1000
    assert {r[0]: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_repeats_with_shared_ids_and_segments(spark, monkeypatch):
    texts = passages()[:40]
    docs = spark.createDataFrame([(None if i % 5 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter(tuple(r)[1:] for r in suffix_dedup.annotate(docs).drop("spans").collect())
    assert got == Counter(removed_by_hand(texts))
    assert suffix_dedup.annotate(docs.limit(0)).count() == 0
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 511)
    data = b"".join(random.Random(1).choices([b"a", b"b", b"cd"], k=4000))
    parts = suffix_dedup._segments(data)
    assert [i + k for i, p in parts for k in range(len(p) - 199)] == list(range(len(data) - 199))


def test_runs_cover_each_start_once_by_the_leftmost_smallest_name():
    random.seed(5)
    parts = [bytes(random.choices(b"abcdefgh", k=700)), b"x" * 400, bytes(random.choices(b"ab", k=200)), b"abc" * 120]
    for part, (at, n, off, v) in zip(parts, suffix_dedup.runs(parts)):
        names = suffix_dedup.seed_names(np.frombuffer(part, np.uint8))
        assert at[0] == 0 and (at[1:] == (at + n)[:-1]).all() and (at + n)[-1] == len(part) - 199
        for a, k, o, x in zip(at.tolist(), n.tolist(), off.tolist(), v.tolist()):
            for s in range(a, a + k):
                window = names[s : s + suffix_dedup.WINDOW] >> np.uint64(suffix_dedup.PLACE)
                assert s + window.argmin() == a + o and names[a + o] == np.uint64(x)


def by_hand(rows, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q % 10:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(usable) if j != at and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(400, 16)) * 0.3).astype(np.float32))]
    rows += [(400 + i, [0.5] * 16) for i in range(40)] + [(500, None), (510, []), (520, [1.0, None]), (530, [float("nan")] * 16), (540, [float("inf")] * 16), (None, [1.0] * 16), (550, [1.0, 2.0]), (551, [2.0, -1.0]), (10, rows[10][1]), (560, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    is_query = F.col("vec_id") % 10 == 0
    for per_pass in (10_000, 9):
        got = exact_topk.search(vectors, is_query, per_pass=per_pass)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, 10)
    assert exact_topk.search(vectors.limit(0), is_query).count() == 0


def test_topk_with_one_query_id_on_many_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(300, 16)) * 0.1).astype(np.float32))]
    rows += [(20, [float(np.float32(x + j / 64)) for x in [3.0] * 16]) for j in range(3)] + [(20, [3.0] * 16)] * 22
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = exact_topk.search(vectors, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 10)


def test_topk_reads_few_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(3000, 32)) * 0.2).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    read, plain = [], exact_topk._read

    def counted(wanted, exact, queries):
        read.append(wanted.count())
        return plain(wanted, exact, queries)

    monkeypatch.setattr(exact_topk, "_read", counted)
    got = exact_topk.search(vectors, F.col("vec_id") % 100 == 0)
    assert got.count() == 300
    assert read[0] == 300 and sum(read) < 30 * 40  # of 30 x 2999 pairs


def test_topk_with_a_common_vector_and_huge_components(spark):
    rows = [(i, [0.25, -0.5, 1.0]) for i in range(60)] + [(100 + i, [float(i), 1.0, -2.0]) for i in range(30)]
    rows += [(200, [3e38, 1.0, 1.0]), (210, [-3e38, 3e38, 0.0]), (0, [0.25, -0.5, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, exact_topk.search(vectors, F.col("vec_id") % 10 == 0).collect()))
    most, clip = 2**63 - 1, lambda x: max(-(2**63), min(2**63 - 1, x))
    usable = [(i, [clip(int(np.floor(1024 * float(np.float32(x))))) for x in v]) for i, v in rows]
    want = []
    for at, (q, v) in enumerate(usable):
        if q % 10 == 0:
            found = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for j, (i, w) in enumerate(usable) if j != at)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert got == sorted(want)
