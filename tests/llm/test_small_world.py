"""Approximate search against brute force: recall on the tables, whole results on small ones."""

import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewire.llm import queries, small_world

SCHEMA = "vec_id long, embedding array<double>"


def by_hand(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = defaultdict(list)
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            out[i].append(sorted((-float(np.dot(v, w)), j) for b, (j, w) in enumerate(good) if b != a and len(v) == len(w))[:k])
    return out


def found(result):
    out = defaultdict(dict)
    for r in result.collect():
        out[r["query_id"]][r["rank"]] = (-r["score"], r["vec_id"])
    return {q: [rows[i] for i in range(1, len(rows) + 1)] for q, rows in out.items()}


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()]
    got, want = found(queries.op12_small_world(spark, "/root/testdata/sf0.1")), by_hand(rows, 20, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near) and q not in {i for _, i in near}
        assert all(abs(-s - float(vectors[q] @ vectors[i])) < 1e-12 for s, i in near)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in w[0]}) / 20 for q, w in want.items()]) >= 0.97


def test_recall_within_a_graph_of_several_layers():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(30, 24))
    vectors = (middle[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 24))) * rng.uniform(0.5, 2, (6000, 1))  # lengths differ
    sizes = small_world.layer_sizes(6000, 24)
    graph = small_world.Graph.build(small_world.lengthened(vectors), sizes)
    assert len(sizes) >= 3 and sizes == sorted(sizes) and sizes[-1] == 6000
    assert [layer.links.max() < n for layer, n in zip(graph.layers, sizes)] == [True] * len(sizes)
    asked = vectors[::40]
    got = graph.search(small_world.directions(asked))
    want = np.argsort(-(asked @ vectors.T), axis=1)[:, :20]
    assert np.mean([len(set(g.tolist()) & set(w.tolist())) / 20 for g, w in zip(got, want)]) >= 0.95


def test_small_tables_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-9, 10, size=(90, 6)))]
    rows += [(100 + i, [3.0, 1.0, 0.0, 0.0, 2.0, 1.0]) for i in range(70)]  # a common vector
    rows += [(10, rows[10][1]), (10, [1.0] * 6), (200, None), (210, []), (220, [None] * 6), (230, [float("nan")] * 6), (240, [float("inf")] * 6), (250, [0.0] * 6), (None, [1.0] * 6), (260, [1.0, 2.0]), (261, [2.0, 0.5]), (270, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "N": F.lit("mine"), "score": F.lit(0.5)}).repartition(4)
    want = by_hand(rows, 10, 5)
    for more in ({}, {"max_shard": 40}, {"per_pass": 7}):
        got = sorted((q, r["rank"], -r["score"], r["vec_id"]) for r in small_world.search(vectors, F.col("vec_id") % 10 == 0, k=5, **more).collect() if (q := r["query_id"]) is not None)
        assert got == sorted((q, n + 1, s, i) for q, lists in want.items() for near in lists for n, (s, i) in enumerate(near))
    assert small_world.search(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_and_small_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i - 20), 1e-3, float(i)]) for i in range(40)] + [(50, [1e-200, 0.0, 1e-200])]
    got = found(small_world.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, k=50))
    want = by_hand(rows, 10, 50)
    for q, near in got.items():  # sums of such numbers round
        assert near == sorted(near) and {i for _, i in near} == {i for _, i in want[q][0]}
        assert np.allclose([s for s, _ in near], [s for s, _ in want[q][0]], rtol=1e-9)
