"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph a shard.

Equal vectors are one point of the index, which lists the k + 1 smallest ids of them; no other row
of that vector can be a result. Points are dealt out by a hash of their vector to shards of at
most about MAX_SHARD points. Each shard's graph is built in one task and stored as a row of flat
arrays; a search sends the queries to all shards and merges what they find.

The graph: a point's highest layer is drawn with a chance of 1 / LINKS a layer, and points are numbered in
the order of their layers, from the highest, so that layer l is over the points 0 .. n_l - 1 and is an
(n_l, width) array of neighbour numbers, -1 where there is none. Layers are built from the top,
each in the order of the numbers and in batches: a batch looks for its neighbours in the graph so
far, by a beam search that starts where the layers above lead to, and among itself; it keeps
those that are nearer to it than to one another, and links back are cut the same way. Beam
searches of many points go on in step, in numpy.

Vectors get one component more, which gives all of them the same length (that of the longest):
among them inner products order as distances do, and a query whose additional component is 0 has
the inner products of the vectors themselves. Shards answer in single precision with a beam of
BEAM points; these are scored anew on the vectors in double precision.

Defined results: rows with a null id or a null, empty or zero vector or any null or non-finite
component take no part, neither as query nor as candidate; a query's own row is no candidate,
another row of its id is one; every query row has its results; equal scores go to the smaller id;
fewer than k candidates give all of them; vectors of different lengths don't meet; an empty table
gives an empty result. Columns besides the two named ones are not read. The result is approximate:
recall is measured by tests and stated in the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialise

#: Points of a shard: at most about so many; and so many before cores alone call for another shard.
MAX_SHARD, LEAST_SHARD = 50_000, 1_000
#: Links of a new point, half the width of the lowest layer.
LINKS = 16
#: Beams while building and while searching.
BUILD_BEAM, BEAM = 64, 128
#: Points that join a layer at a time; queries that go in step.
BATCH, QUERY_BLOCK = 512, 512
QUERIES_A_PASS = 20_000
INDEX = "length int, n int, vectors binary, members array<array<struct<id:bigint,row:bigint>>>, sizes array<int>, links binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v), written: the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    few = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0))
    return materialise(few.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v")), "points")


def distinct_points(points: DataFrame, k: int) -> DataFrame:
    """(key, v, members), written: a row for each vector, with its k + 1 first rows by id."""
    keyed = points.select(F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("key_2"), "id", "row", "v")
    place = F.row_number().over(Window.partitionBy("key", "key_2").orderBy("id", "row"))  # cut in every task before the shuffle
    few = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members")  # k + 1 at most
    return materialise(few.groupBy("key", "key_2").agg(F.any_value("v").alias("v"), members).drop("key_2"), "distinct-points")


class Layer:
    """A layer of the graph while it is built or searched: neighbour numbers, -1 where there is none."""

    def __init__(self, links: np.ndarray):
        self.links = links

    def walk(self, points: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the numbers of `beam` near points and their products, nearest first; -1 where fewer are found."""
        n, most = len(queries), min(beam, len(self.links))
        seen = np.zeros((n, len(self.links)), bool)
        number, near, done = np.full((n, most), -1, np.int32), np.full((n, most), -np.inf, np.float32), np.ones((n, most), bool)
        number[:, 0], done[:, 0] = entry, False
        near[:, 0] = np.einsum("ij,ij->i", points[entry], queries)
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            first = np.argmin(done[active], axis=1)
            going = ~done[active, first]
            active, first = active[going], first[going]
            if not len(active):
                break
            done[active, first] = True
            found = self.links[number[active, first]]
            fresh = (found >= 0) & ~seen[active[:, None], np.maximum(found, 0)]
            i, j = np.nonzero(fresh)
            to = found[i, j]
            seen[active[i], to] = True
            value = np.full(found.shape, -np.inf, np.float32)
            value[i, j] = np.einsum("ij,ij->i", points[to], queries[active[i]])
            changed = np.flatnonzero((value > near[active, -1:]).any(1))
            if len(changed):
                a = active[changed]
                both = np.concatenate([near[a], value[changed]], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :most]
                near[a] = np.take_along_axis(both, order, 1)
                number[a] = np.take_along_axis(np.concatenate([number[a], found[changed]], axis=1), order, 1)
                done[a] = np.take_along_axis(np.concatenate([done[a], ~fresh[changed]], axis=1), order, 1)
        number[np.isneginf(near)] = -1
        return number, near


def diverse(points: np.ndarray, candidates: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """For each row the numbers of at most `width` candidates (-1: none; in the order of nearness).

    A candidate is kept if it is nearer to the row's own point than to all that are kept before
    it; places that are left go to the nearest of the others.
    """
    rows, many = candidates.shape
    out = np.full((rows, width), -1, np.int32)
    step = max(1, 4_000_000 // max(1, many * points.shape[1]))
    for a in range(0, rows, step):
        c, s = candidates[a : a + step], near[a : a + step]
        there = c >= 0
        x = points[np.maximum(c, 0)]
        between = x @ x.transpose(0, 2, 1)
        kept, count, closest = np.zeros(c.shape, bool), np.zeros(len(c), np.int64), np.full(c.shape, -np.inf, np.float32)
        for j in range(many):
            take = there[:, j] & (s[:, j] > closest[:, j]) & (count < width)
            kept[:, j] = take
            count += take
            some = np.flatnonzero(take)
            closest[some] = np.maximum(closest[some], between[some, j])
        order = np.argsort(~there * 2 + ~kept, axis=1, kind="stable")[:, :width]
        out[a : a + step, : order.shape[1]] = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(c, order, 1), -1)
    return out


def _linked_back(links: np.ndarray, points: np.ndarray, start: int, made: np.ndarray) -> None:
    """Links from the neighbours of the new points start, start + 1, ... to these."""
    width = links.shape[1]
    i, j = np.nonzero(made >= 0)
    to, new = made[i, j], (start + i).astype(np.int32)
    old = (links[to] == new[:, None]).any(1)  # the neighbour is of the same batch and links it already
    to, new = to[~old], new[~old]
    value = np.einsum("ij,ij->i", points[to], points[new])
    order = np.lexsort((-value, to))
    to, new = to[order], new[order]
    at, first, size = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, size)
    near_enough = rank < width  # no list takes more
    extra = np.full((len(at), width), -1, np.int32)
    extra[np.repeat(np.arange(len(at)), size)[near_enough], rank[near_enough]] = new[near_enough]
    both = np.concatenate([links[at], extra], axis=1)
    full = (both >= 0).sum(1) > width
    front = np.argsort(both[~full] < 0, axis=1, kind="stable")[:, :width]
    links[at[~full]] = np.take_along_axis(both[~full], front, 1)
    if full.any():
        at, both = at[full], both[full]
        step = max(1, 4_000_000 // (both.shape[1] * points.shape[1]))
        for a in range(0, len(at), step):
            c = both[a : a + step]
            near = np.where(c >= 0, np.einsum("ijk,ik->ij", points[np.maximum(c, 0)], points[at[a : a + step]]), -np.inf).astype(np.float32)
            order = np.argsort(-near, axis=1, kind="stable")
            links[at[a : a + step]] = diverse(points, np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1), width)


class Graph:
    """The layers over one shard's points, the widest last."""

    def __init__(self, points: np.ndarray, layers: list[Layer]):
        self.points, self.layers = points, layers

    def entry(self, queries: np.ndarray, depth: int, most: int) -> np.ndarray:
        """Where the layers above `depth` lead to, as a number below `most`."""
        at = np.zeros(len(queries), np.int64)
        for layer in self.layers[:depth]:
            at = layer.walk(self.points, queries, at, 1)[0][:, 0].astype(np.int64)
        return np.where(at < most, at, 0)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Numbers of the `beam` points found for each query, -1 where there are fewer."""
        last = len(self.layers) - 1
        found = [self.layers[last].walk(self.points, q, self.entry(q, last, len(self.points)), beam)[0] for q in (queries[a : a + QUERY_BLOCK] for a in range(0, len(queries), QUERY_BLOCK))]
        return np.concatenate(found) if found else np.empty((0, beam), np.int32)

    @staticmethod
    def build(points: np.ndarray, sizes: list[int], beam: int = BUILD_BEAM) -> Graph:
        """sizes: how many points each layer has, from the top; the last has all."""
        graph = Graph(points, [])
        for depth, size in enumerate(sizes):
            width = 2 * LINKS if depth == len(sizes) - 1 else LINKS
            layer = Layer(np.full((size, width), -1, np.int32))
            start = 0
            while start < size:
                stop = min(size, start + min(BATCH, max(64, start)))
                new = points[start:stop]
                among = new @ new.T
                np.fill_diagonal(among, -np.inf)
                order = np.argsort(-among, axis=1, kind="stable")[:, : min(beam, stop - start - 1)]
                candidates, near = (order + start).astype(np.int32), np.take_along_axis(among, order, 1)
                if start:
                    sofar = Layer(layer.links[:start])
                    found, value = sofar.walk(points, new, graph.entry(new, depth, start), beam)
                    candidates, near = np.concatenate([found, candidates], axis=1), np.concatenate([value, near], axis=1)
                    order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
                    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
                made = diverse(points, candidates, near, LINKS)
                layer.links[start:stop, :LINKS] = made
                _linked_back(layer.links, points, start, made)
                start = stop
            graph.layers.append(layer)
        return graph


def layer_sizes(n: int, seed: int) -> list[int]:
    """How many of n points have each layer, from the top."""
    highest = np.random.default_rng(seed).geometric(1 - 1 / LINKS, n) - 1
    return [int((highest >= layer).sum()) for layer in range(int(highest.max(initial=0)), -1, -1)]


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors, made shorter alike, with one component more: all have length 1. In single precision."""
    scaled = vectors / np.abs(vectors).max(initial=1e-300)
    squares = np.einsum("ij,ij->i", scaled, scaled)
    longest = squares.max(initial=1e-300)
    return (np.concatenate([scaled, np.sqrt(np.maximum(longest - squares, 0))[:, None]], axis=1) / np.sqrt(longest)).astype(np.float32)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 with one component more, which is 0. In single precision."""
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)
    return np.concatenate([scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None], np.zeros((len(vectors), 1))], axis=1).astype(np.float32)


def build(points: DataFrame, shards: int) -> DataFrame:
    """The index, written: a row of INDEX for each shard and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_shard = [b for b in batches if b.num_rows]  # MAX_SHARD points or so
        if not of_shard:
            return
        whole = pa.Table.from_batches(of_shard).sort_by([("key", "ascending")]).combine_chunks().to_batches()[0]
        lengths = whole.column("v").value_lengths().to_numpy()
        for size in np.unique(lengths).tolist():
            part = whole.filter(pa.array(lengths == size))
            vectors = part.column("v").flatten().to_numpy().reshape(-1, size)
            sizes = layer_sizes(len(vectors), size)
            graph = Graph.build(lengthened(vectors), sizes)
            links = b"".join(layer.links.tobytes() for layer in graph.layers)
            values = [[size], [len(vectors)], [vectors.tobytes()], [part.column("members").to_pylist()], [sizes], [links]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, kinds)], names)

    made = to_arrow_schema(StructType.fromDDL(INDEX))
    kinds, names = made.types, made.names
    few = points.select("key", "v", "members")
    return materialise(few.repartitionById(shards, F.pmod("key", F.lit(shards)).cast("int")).mapInArrow(run, INDEX), "graphs")


def loaded(row: dict) -> tuple[np.ndarray, Graph]:
    """(vectors, graph) of a row of the index."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["length"])
    flat, layers, at = np.frombuffer(row["links"], np.int32), [], 0
    for depth, size in enumerate(row["sizes"]):
        width = 2 * LINKS if depth == len(row["sizes"]) - 1 else LINKS
        layers.append(Layer(flat[at : at + size * width].reshape(size, width)))
        at += size * width
    return vectors, Graph(lengthened(vectors), layers)


def _found(index: DataFrame, queries: list[list[float]], k: int, beam: int) -> DataFrame:
    """(n, score, members): for each query number the k + 1 best points of every shard."""
    by_length: dict[int, list[int]] = {}
    for n, v in enumerate(queries):
        by_length.setdefault(len(v), []).append(n)
    shared = index.sparkSession.sparkContext.broadcast({size: (np.array(ns), np.array([queries[n] for n in ns], np.float64)) for size, ns in by_length.items()})
    kind = pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["length"] not in shared.value:
                    continue
                numbers, q = shared.value[row["length"]]
                vectors, graph = loaded(row)
                members = pa.array(row["members"], kind)
                lookups = directions(q)
                for a in range(0, len(q), QUERY_BLOCK):
                    found = graph.search(lookups[a : a + QUERY_BLOCK], max(beam, k + 1))
                    i, j = np.nonzero(found >= 0)
                    to = found[i, j]
                    score = np.einsum("ij,ij->i", vectors[to], q[a + i])
                    order = np.lexsort((to, -score, i))
                    i, to, score = i[order], to[order], score[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) <= k
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[a + i[best]]), pa.array(score[best]), members.take(pa.array(to[best]))], ["n", "score", "members"])

    return index.mapInArrow(run, "n long, score double, members array<struct<id:bigint,row:bigint>>")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, max_shard: int = MAX_SHARD, per_pass: int = QUERIES_A_PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): k near other rows of every row that meets is_query, a condition on the id column."""
    points = usable(vectors, id_col, vector_col)
    distinct = distinct_points(points, k)
    n = distinct.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    index = build(distinct, max(1, min(cores, n // LEAST_SHARD), -(-n // max_shard)))
    asked = materialise(points.withColumnRenamed("id", id_col).where(is_query).select("row", F.col(id_col).alias("id"), "v"), "queries")
    passes = max(1, -(-asked.count() // per_pass))
    out = []
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row").collect()
        if some:
            own = F.broadcast(vectors.sparkSession.createDataFrame([(i, r["id"], r["row"]) for i, r in enumerate(some)], "n long, query_id long, own long"))
            best = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), F.col("members")[0]["id"]))
            near = _found(index, [r["v"] for r in some], k, beam).withColumn("place", best).where(F.col("place") <= k + 1)
            rows = near.select("n", "score", F.explode("members").alias("m")).join(own, "n").where(F.col("m.row") != F.col("own"))
            rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "m.id", "m.row"))
            out.append(rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("m.id").alias(id_col), "score"))
    if not out:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    return reduce(DataFrame.union, out)
