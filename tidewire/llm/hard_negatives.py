"""Hard negatives of anchors by slot-decomposed selection.

A row's score is its integer inner product with the anchor (components are floor of SCALE times
the value); higher scores come first, ties by the smaller id. An anchor's positives are its first
`positives` other rows of the same label. A positive of score p has the window LOW p <= OF s,
s <= p of scores s, and gets the first `negatives` rows of another label in it.

1. Positives: every task keeps each anchor's first rows of its label, then the same over tasks.
2. Slots: the scores of an anchor's positives, in descending order, are upper limits that split all
   scores into disjoint slots (u2, u1], (u3, u2], ... A task puts a row of another label into its
   slot and keeps the first rows of every slot, then the same over tasks. A window begins at one
   of the limits, so its first rows are the first of its slot followed by those of the slots below.
3. Windows: slots are merged downwards, from the lowest to the highest limit; the merged list at a
   positive's limit, cut at its lower end, is its answer. All windows of an anchor, however they
   overlap, are answered from one list of at most positives x negatives rows.

Rows below LOW / OF of their own slot's limit are in no window and are not kept. The anchors are
stated by the caller; they travel in passes of about ANCHORS_A_PASS broadcast vectors, so memory
is bounded at any size, and what a task keeps depends on anchors, never on its rows.

Defined results: rows with a null id, a null label, a null or empty vector or any null or
non-finite component take no part; an anchor's own row is no positive, another row of its id may
be one; repeated rows each count; every anchor row has its results; fewer rows than asked for give
all; vectors of different lengths don't meet; a negative positive score has an empty window;
components and scores beyond 63 bits count as the largest number of 63 bits; an empty table gives
an empty result. Columns besides the three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

SCALE = 256
#: The lower end of a window, LOW / OF of its positive's score.
LOW, OF = 80, 100
ANCHORS_A_PASS = 10_000
#: Rows and anchors that are multiplied at a time.
BLOCK, ANCHOR_BLOCK = 4096, 256
LARGEST = 2**63 - 1
NONE = -(2**63)


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(row, id, label, v), written: the rows that take part, with whole components."""
    x, all_ = F.col(vector_col), [F.col(c).isNotNull() for c in (id_col, label_col, vector_col)]
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint"))
    few = vectors.where(reduce(Column.__and__, all_) & (F.size(x) > 0) & finite)
    return materialise(few.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("v")), "labelled")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q with all of v, at most LARGEST either way."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**62:
        return q @ v.T
    exact = q.astype(object) @ v.T.astype(object)
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def first(score: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores the places of its k largest, ties by the smaller place."""
    width = score.shape[1]
    if width <= k:
        return np.argsort(-np.maximum(score, -LARGEST), axis=1, kind="stable")
    known = score[score != NONE]
    if float(np.abs(known.astype(np.float64)).max(initial=0)) * width < 2.0**61:
        key = np.where(score == NONE, -(2**61) // width - 1, score) * width + (width - 1 - np.arange(width))
        return np.argpartition(key, width - k, axis=1)[:, width - k :]
    return np.argsort(-np.maximum(score, -LARGEST), axis=1, kind="stable")[:, :k]


class Best:
    """The first k rows of each of n anchors, over the blocks of a task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), NONE), np.full((n, k), LARGEST), np.full((n, k), LARGEST)

    def add(self, at: slice, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the block's rows, which are in the order of their ids; NONE where a row is out."""
        some = np.flatnonzero((score >= self.score[at, -1:]).any(1) & (score != NONE).any(1))
        if not len(some):
            return
        to, score = some + at.start, score[some]
        place = first(score, self.k)
        new = np.take_along_axis(score, place, 1)
        out = new == NONE
        both = [np.concatenate([x[to], y], axis=1) for x, y in ((self.score, new), (self.id, np.where(out, LARGEST, ids[place])), (self.row, np.where(out, LARGEST, rows[place])))]
        order = np.lexsort((both[2], both[1], -np.maximum(both[0], -LARGEST)), axis=1)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(both[0] == NONE, order, 1), axis=1, kind="stable"), 1)[:, : self.k]
        self.score[to], self.id[to], self.row[to] = (np.take_along_axis(x, order, 1) for x in both)

    def rows(self, numbers: np.ndarray, slot: int) -> pa.RecordBatch:
        i, j = np.nonzero(self.score != NONE)
        made = [numbers[i], np.full(len(i), slot, np.int32), self.score[i, j], self.id[i, j], self.row[i, j]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, made)), ["n", "slot", "score", "id", "row"])


class Anchors:
    """Anchors of one vector length: numbers, rows, labels, vectors and upper limits of slots."""

    def __init__(self, listed: list[tuple], limits: dict[int, list[int]] | None):
        self.numbers = np.array([n for n, *_ in listed], np.int64)
        self.rows = np.array([row for _, row, _, _ in listed], np.int64)
        self.labels = [label for _, _, label, _ in listed]
        self.vectors = np.array([v for *_, v in listed], np.int64)
        most = max((len(limits.get(n, ())) for n in self.numbers.tolist()), default=0) if limits is not None else 0
        self.limits = np.full((len(listed), most), NONE)
        for i, n in enumerate(self.numbers.tolist()):
            own = (limits or {}).get(n, [])
            self.limits[i, : len(own)] = own
        # a slot's lower end: above the next limit, and within the window of its own
        below = np.concatenate([self.limits[:, 1:], np.full((len(listed), 1), NONE)], axis=1)[:, :most]
        fifths = np.array([[-(-LOW * int(x) // OF) if x != NONE else 0 for x in xs] for xs in self.limits.tolist()], object).reshape(self.limits.shape)
        self.least = np.maximum(np.where(below == NONE, NONE, below + 1), np.clip(fifths, -LARGEST, LARGEST).astype(np.int64)) if most else below

    def slots(self) -> int:
        return self.limits.shape[1]


def _scanned(table: DataFrame, anchors: list[tuple], k: int, limits: dict[int, list[int]] | None = None) -> DataFrame:
    """(n, slot, score, id, row) that each task keeps: rows of the anchor's label, or with limits rows of others by slot."""
    by_length: dict[int, list[tuple]] = {}
    for a in anchors:
        by_length.setdefault(len(a[3]), []).append(a)
    shared = table.sparkSession.sparkContext.broadcast([Anchors(listed, limits) for listed in by_length.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {a.vectors.shape[1]: (a, [Best(len(a.rows), k) for _ in range(max(1, a.slots()))]) for a in shared.value}
        known = {size: pa.array(sorted(set(a.labels))) for size, (a, _) in groups.items()}
        of_anchor = {size: pc.index_in(pa.array(a.labels), known[size]).to_numpy() for size, (a, _) in groups.items()}
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                length = part.column("v").value_lengths().to_numpy()
                for size in np.unique(length).tolist():
                    if size not in groups:
                        continue
                    of_size = part.filter(pa.array(length == size)) if (length != size).any() else part
                    ids, rows = (of_size.column(c).to_numpy() for c in ("id", "row"))
                    order = np.lexsort((rows, ids))
                    ids, rows = ids[order], rows[order]
                    vectors = of_size.column("v").flatten().to_numpy().reshape(-1, size)[order]
                    label = pc.fill_null(pc.index_in(of_size.column("label"), known[size]), -1).to_numpy()[order]
                    a, best = groups[size]
                    for i in range(0, len(a.rows), ANCHOR_BLOCK):
                        at = slice(i, min(i + ANCHOR_BLOCK, len(a.rows)))
                        score = products(a.vectors[at], vectors)
                        same = of_anchor[size][at, None] == label[None, :]
                        if limits is None:
                            best[0].add(at, np.where(same & (a.rows[at, None] != rows[None, :]), score, NONE), ids, rows)
                            continue
                        for s in range(a.slots()):
                            within = ~same & (score <= a.limits[at, s, None]) & (score >= a.least[at, s, None]) & (a.limits[at, s, None] != NONE)
                            best[s].add(at, np.where(within, score, NONE), ids, rows)
        for a, best in groups.values():
            for s, b in enumerate(best):
                yield b.rows(a.numbers, s)

    return table.mapInArrow(run, "n long, slot int, score long, id long, row long")


def _merged(slots: DataFrame, negatives: int) -> DataFrame:
    """(n, merged): for every slot of an anchor, from the highest, the first rows of it and of all slots below."""
    one = F.struct(F.lit(0).alias("slot"), F.array().cast("array<struct<rank:int,score:bigint,id:bigint>>").alias("rows"))
    place = F.row_number().over(Window.partitionBy("n", "slot").orderBy(F.desc("score"), "id", "row"))
    kept = slots.withColumn("rank", place).where(F.col("rank") <= negatives)
    tops = kept.groupBy("n", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("rows"))
    upward = F.sort_array(F.collect_list(F.struct("slot", "rows")), asc=False)  # at most a struct a positive
    step = lambda done, x: F.array_append(done, F.struct(x["slot"].alias("slot"), F.slice(F.concat(x["rows"], F.try_element_at(done, F.lit(-1))["rows"]), 1, negatives).alias("rows")))
    return tops.groupBy("n").agg(F.aggregate(upward, F.array(one), step).alias("merged")).select("n", F.reverse(F.slice("merged", 2, 2**31 - 1)).alias("merged"))


def _of_pass(table: DataFrame, anchors: list[tuple], positives: int, negatives: int) -> DataFrame:
    """(n, positive_id, rank, negative_id, positive_score, negative_score) of numbered anchors."""
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id", "row"))
    found = materialise(_scanned(table, anchors, positives).withColumn("rank", place).where(F.col("rank") <= positives).select("n", "rank", "score", "id"), "positives")
    limits: dict[int, list[int]] = {}
    for n, score in found.select("n", "score").distinct().collect():  # `positives` numbers an anchor of the pass
        limits.setdefault(n, []).append(score)
    limits = {n: sorted(scores, reverse=True) for n, scores in limits.items()}
    slot = F.dense_rank().over(Window.partitionBy("n").orderBy(F.desc("score"))) - 1
    wanted = found.select("n", slot.alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    merged = _merged(_scanned(table, anchors, negatives, limits), negatives)
    # the list at the positive's limit is that of the first slot from there that has rows
    rows = F.try_element_at(F.filter("merged", lambda m: m["slot"] >= F.col("slot")), F.lit(1))["rows"]
    out = wanted.join(merged, "n").select("n", "positive_id", "positive_score", F.posexplode(rows).alias("place", "r"))
    big = lambda c: c.cast("decimal(38,0)")
    window = (big(F.col("positive_score")) * LOW <= big(F.col("r.score")) * OF) & (F.col("r.score") <= F.col("positive_score"))
    return out.where(window).select("n", "positive_id", (F.col("place") + 1).alias("rank"), F.col("r.id").alias("negative_id"), "positive_score", F.col("r.score").alias("negative_score"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", per_pass: int = ANCHORS_A_PASS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet is_anchor.

    is_anchor is a condition on the id column.
    """
    table = usable(vectors, id_col, label_col, vector_col)
    chosen = materialise(table.withColumnRenamed("id", id_col).where(is_anchor).select("row", F.col(id_col).alias("id"), "label", "v"), "anchors")
    passes = max(1, -(-chosen.count() // per_pass))
    found = []
    for p in range(passes):
        some = chosen.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row").collect()
        if some:
            ids = F.broadcast(vectors.sparkSession.createDataFrame([(n, r["id"]) for n, r in enumerate(some)], "n long, anchor_id long"))
            of_pass = _of_pass(table, [(n, r["row"], r["label"], r["v"]) for n, r in enumerate(some)], positives, negatives)
            found.append(of_pass.join(ids, "n").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(chosen)
    if not found:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, found)
