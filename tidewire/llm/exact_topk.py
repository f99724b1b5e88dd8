"""Exact top-k search by inner product over a vector-approximation file.

Components are integers (floor of SCALE times the value). Two tables are written: the exact
vectors, and the approximation, one byte a component: the cell of the component on the vector's
own grid of 256 cells (`base` and `step`). Cells bound a score from below and above with one
product of bytes:  s = base * sum(q) + step * (q . cells)  lies between
s + (step - 1) * sum(q-)  and  s + (step - 1) * sum(q+).

1. Scan: each task reads cells only and keeps, for every query, the rows whose upper bound
   reaches the kth largest lower bound it has seen; then the same over all tasks.
2. Read: exact vectors are fetched in the order of their bounds, first the k best of each query,
   then those whose upper bound still reaches the kth exact score. The rest is never read, and
   the result is certain.

Of rows with equal vectors only the k + 1 smallest ids can be results, so a vector that very many
rows share is kept k + 1 times; and of rows whose cells tell their score, all equal to the kth, a
task keeps the k smallest ids (a query of zeros ties with all). The query set is stated by the caller. It travels in passes of at
most QUERIES_A_PASS broadcast queries, so its memory is bounded at any size.

Defined results: vectors that are null, hold a null or non-finite component, or have no id
take no part, neither as query nor as candidate; a query's own row is no candidate, another row
of its id is one; every query row has its results; scores that tie go to the smaller id; fewer
than k candidates give all; vectors of different lengths don't meet; components and scores
beyond 63 bits count as the largest number of 63 bits; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 1024
CELLS = 256
QUERIES_A_PASS = 10_000
#: Vectors of a block; queries bounded against it at a time.
BLOCK, QUERY_BLOCK = 8192, 256
LARGEST = 2**63 - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors as arrays of long."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(usable & finite).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint")).alias("v"))


def exact_file(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v), written; of equal vectors the k + 1 smallest ids."""
    first = Window.partitionBy("v").orderBy("id")
    few = integers(vectors, id_col, vector_col).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    return materialise(few.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def approximation_file(exact: DataFrame) -> DataFrame:
    """(row, id, length, base, step, cells), written: a byte for each component."""
    base, most = F.array_min("v"), F.array_max("v")
    step = F.floor((most.cast("decimal(38,0)") - base) / F.lit(CELLS)).cast("bigint") + 1
    few = exact.select("row", "id", "v", base.alias("base"), step.alias("step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = batch.column("v").flatten().to_numpy(), batch.column("v").value_lengths().to_numpy()
            base, step = (np.repeat(batch.column(c).to_numpy(), size) for c in ("base", "step"))
            cells = ((v.view(np.uint64) - base.view(np.uint64)) // step.view(np.uint64)).astype(np.uint8)  # differences of 64 bits, unsigned
            ends = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(size, pa.int32()), batch.column("base"), batch.column("step"), packed], ["row", "id", "length", "base", "step", "cells"])

    return materialise(few.mapInArrow(run, "row long, id long, length int, base long, step long, cells binary"), "cells")


class Bounds:
    """For each query of one length the rows that cells leave open, over the blocks of a task."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.q = vectors.astype(np.float64)
        self.all, self.up, self.down = self.q.sum(1), np.maximum(self.q, 0).sum(1), np.minimum(self.q, 0).sum(1)
        self.least = np.full((len(rows), k), -np.inf)  # the k largest lower bounds so far
        self.open: list[list[tuple[np.ndarray, ...]]] = [[] for _ in rows]  # high, low, row, id

    def add(self, rows: np.ndarray, ids: np.ndarray, base: np.ndarray, step: np.ndarray, cells: np.ndarray) -> None:
        base, step, cells = base.astype(np.float64), step.astype(np.float64), cells.astype(np.float64).T
        for a in range(0, len(self.rows), QUERY_BLOCK):
            at = slice(a, a + QUERY_BLOCK)
            known = np.outer(self.all[at], base) + (self.q[at] @ cells) * step
            low, high = known + np.outer(self.down[at], step - 1), known + np.outer(self.up[at], step - 1)
            slack = 1e-9 * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
            slack = slack if slack > 1e6 else 0.0  # below 2^50 all sums are exact
            low, high = low - slack, high + slack
            own = rows[None, :] == self.rows[at, None]
            low[own] = high[own] = -np.inf
            both = np.concatenate([self.least[at], low], axis=1)
            self.least[at] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            floor = self.least[at].min(1)
            for q, i in enumerate((high >= floor[:, None]) & (high > -np.inf)):
                i = np.flatnonzero(i)
                self.open[a + q].append((high[q, i], low[q, i], rows[i], ids[i]))
            if len(self.open[a]) > 8:
                self._pruned(at)

    def _pruned(self, at: slice) -> None:
        for q in range(*at.indices(len(self.rows))):
            if self.open[q]:
                x = [np.concatenate(c) for c in zip(*self.open[q])]
                floor = self.least[q].min()
                still = x[0] >= floor
                tied = np.flatnonzero((x[0] == floor) & (x[1] == floor))
                if len(tied) > self.k:
                    still[tied[np.lexsort((x[2][tied], x[3][tied]))[self.k :]]] = False
                self.open[q] = [tuple(c[still] for c in x)]

    def left(self) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """(query, (high, low, row, id)) of what is open."""
        self._pruned(slice(0, len(self.rows)))
        yield from ((q, x[0]) for q, x in enumerate(self.open) if x and len(x[0][0]))


def _by_length(queries: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, rows, vectors) of the queries of each length."""
    out: dict[int, list[int]] = {}
    for n, (_, _, v) in enumerate(queries):
        out.setdefault(len(v), []).append(n)
    return [(np.array(ns), np.array([queries[n][0] for n in ns], np.int64), np.array([queries[n][2] for n in ns], np.int64)) for ns in out.values()]


def _scanned(cells: DataFrame, queries: list, k: int) -> DataFrame:
    """(n, row, high, low): what each task leaves open for query number n."""
    shared = cells.sparkSession.sparkContext.broadcast(_by_length(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {v.shape[1]: (ns, Bounds(rows, v, k)) for ns, rows, v in shared.value}
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                row, id_, length, base, step = (part.column(c).to_numpy() for c in ("row", "id", "length", "base", "step"))
                for n in np.unique(length).tolist():
                    if n in bounds:
                        at = np.flatnonzero(length == n)
                        packed = np.frombuffer(b"".join(part.column("cells").take(pa.array(at)).to_pylist()), np.uint8)
                        bounds[n][1].add(row[at], id_[at], base[at], step[at], packed.reshape(len(at), n))
        for ns, b in bounds.values():
            for q, (high, low, row, _) in b.left():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), ns[q])), pa.array(row), pa.array(high), pa.array(low)], ["n", "row", "high", "low"])

    return cells.mapInArrow(run, "n long, row long, high double, low double")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q with those of v, at most LARGEST either way."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    return np.array([max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(x, y)))) for x, y in zip(q.tolist(), v.tolist())], np.int64)


def _read(wanted: DataFrame, exact: DataFrame, queries: list) -> DataFrame:
    """(n, row, id, score) of the wanted (n, row), from their exact vectors."""
    shared = exact.sparkSession.sparkContext.broadcast([np.array(v, np.int64) for _, _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, length = batch.column("n").to_numpy(), batch.column("v").value_lengths().to_numpy()
            v, start = batch.column("v").flatten().to_numpy(), np.r_[0, np.cumsum(length)]
            score = np.zeros(len(n), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                score[at] = products(np.stack([shared.value[i] for i in n[at].tolist()]), v[start[at][:, None] + np.arange(size)])
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("row"), batch.column("id"), pa.array(score)], ["n", "row", "id", "score"])

    return wanted.select("n", "row").join(exact, "row").select("n", "row", "id", "v").mapInArrow(run, "n long, row long, id long, score long")


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query in this order; every task keeps k of its own first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order))).where(F.col("rank") <= k)


def searched(exact: DataFrame, cells: DataFrame, queries: list, k: int) -> DataFrame:
    """(n, rank, id, score) of each query number."""
    found = materialise(_scanned(cells, queries, k), "open")
    floor = _best(found, k, F.desc("low")).groupBy("n").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("all"))
    found = materialise(found.join(floor, "n").where((F.col("all") < k) | (F.col("high") >= F.col("floor"))).select("n", "row", "high"), "candidates")
    first = _best(found, k, F.desc("high"), F.col("row"))
    sure = materialise(_read(first, exact, queries), "first-read")
    kth = sure.groupBy("n").agg(F.min("score").alias("kth"))
    rest = found.join(kth, "n").where(F.col("high") >= F.col("kth")).join(sure.select("n", "row"), ["n", "row"], "left_anti")
    return _best(sure.union(_read(rest, exact, queries)), k, F.desc("score"), F.col("id"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", per_pass: int = QUERIES_A_PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row that meets is_query.

    is_query is a condition on the id column.
    """
    exact = exact_file(vectors, k, id_col, vector_col)
    cells = approximation_file(exact)
    queries = materialise(integers(vectors.where(is_query), id_col, vector_col), "queries")
    passes = max(1, -(-queries.count() // per_pass))
    found = []
    for p in range(passes):
        of_pass = F.pmod(F.xxhash64("id", "v"), F.lit(passes)) == p
        some = sorted((i, tuple(v)) for i, v in queries.where(of_pass).collect())
        if some:
            kept = exact.where(of_pass).join(F.broadcast(queries.where(of_pass).distinct()), ["id", "v"]).select("id", "v", "row")
            own = {(i, tuple(v)): row for i, v, row in kept.collect()}  # of rows that are equal in all, any one
            some = [(own.get(q, -1), *q) for q in some]
            ids = F.broadcast(vectors.sparkSession.createDataFrame([(n, i) for n, (_, i, _) in enumerate(some)], "n long, query_id long"))
            found.append(searched(exact, cells, some, k).join(ids, "n").select("query_id", "rank", F.col("id").alias(id_col), "score"))
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    return reduce(DataFrame.union, found)
