"""Ranked lexical search for many items at once: a dual-tree search, exact.

An item's score of a document is an inner product: each term of the item has a weight, each term
of the document a coordinate,

    weight      w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    coordinate  g = (1000000000 tf) div (1000 tf + 8 m),  m = 10 + ((90 n N) div L)

(N documents with terms, L terms in all, n terms of the document, df documents with the term, tf
its occurrences in the document). Both are whole and not negative, so the maxima of the weights of
some items times the maxima of the coordinates of some documents bound all their scores.

1. Profiles: tasks count each document's terms that items have, over whole texts; N, L and df are
   sums over these rows.
2. Hierarchy of documents: profiles with coordinates are dealt out by range of their rarest terms,
   so that documents alike lie side by side whatever share of them a term has; LEAF documents or
   LEAF_TERMS coordinates make a leaf, a row with its coordinate maxima. Above leaves, a node is FAN nodes.
3. Floors: each task leads every item down to its most promising leaf of each run of leaves; the
   best SEEDS leaves of an item are scored, and their kth score is the item's first floor.
4. Dual tree: pairs of a node of items and nodes of documents are bounded from the roots down and
   left as soon as the bound is below the weakest floor of the node's items. What reaches the
   leaves is scored exactly in the order of its bounds, and floors rise with the kth scores.
   Every task returns its k best of each item; the best of these are the result.

A bound that equals a floor is followed, so ties are decided by ids alone. Items travel in passes
of about TERMS_A_PASS terms, so what is broadcast is bounded; a run holds RUN_CELLS cells.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Defined results: null and empty texts have no term; rows without id take no part, as document or
as item; repeated ids are documents or items of their own; an item without terms has no result;
documents with score 0 are none; equal scores go to the smaller doc_id; empty tables give an empty
result. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, slices

#: Lower-cases A-Z and turns every byte that is in no term to a space.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and coordinates of a leaf; nodes below a node; cells of the maxima of a run of leaves.
LEAF, LEAF_TERMS, FAN, RUN_CELLS = 32, 100_000, 8, 4_000_000
#: Leaves of an item that give its first floor.
SEEDS = 3
TERMS_A_PASS = 1_000_000
#: Bytes of a text that are cut to terms at a time.
PIECE = 1_000_000


def pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data = text.encode().translate(TO_TERMS)
    start = 0
    while start < len(data):
        stop = len(data) if start + PIECE >= len(data) else data.rfind(b" ", start, start + PIECE)
        if stop <= start:  # a term longer than a piece
            stop = data.find(b" ", start + PIECE)
            stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def counted(text: str, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(all terms, numbers of known terms in order, how often each occurs)."""
    size, found = 0, []
    for words in pieces(text):
        size += len(words)
        ids = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
        found.append(ids[ids >= 0])
    terms, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
    return size, terms, times


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, item_id, terms), written: the distinct terms of each item that has some."""
    few = items.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = few.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            terms = [sorted({w for words in pieces(t or "") for w in words}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["row", "item_id", "terms"])

    return materialise(few.mapInArrow(run, f"row long, item_id {kind}, terms array<binary>").where(F.size("terms") > 0), "item-terms")


def profiles(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times), written: of each document the count of its terms, and of those that have a number."""
    few = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            made = [counted(t or "", shared.value) for t in batch.column("text").to_pylist()]
            columns = [pa.array([n for n, _, _ in made], pa.int64()), pa.array([t.tobytes() for _, t, _ in made], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, _, c in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "terms", "times"])

    return materialise(few.mapInArrow(run, "doc_id long, n long, terms binary, times binary"), "profiles")


def document_counts(made: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each numbered term; counts are summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "n"])

    out = np.zeros(terms, np.int64)
    for term, n in made.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[term] = n
    return out


def leaves(made: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """The leaves of the hierarchy of documents, written, side by side in the order of their rarest terms."""
    shared = made.sparkSession.sparkContext.broadcast(weights)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            doc, n = (batch.column(c).to_pylist() for c in ("doc_id", "n"))
            rows: list[tuple] = []
            for i, (t, c) in enumerate(zip(batch.column("terms").to_pylist(), batch.column("times").to_pylist())):
                terms, times = np.frombuffer(t, np.int32), np.frombuffer(c, np.int32).astype(np.int64)
                some = w[terms] > 0
                if some.any():
                    terms, times = terms[some], times[some]
                    m = 100 - 90 + 90 * n[i] * n_docs // n_terms
                    value = (1_000_000_000 * times) // (1000 * times + 8 * m)
                    rare = np.argsort(-w[terms], kind="stable")[:2].tolist()
                    rows.append((int(terms[rare[0]]), int(terms[rare[-1]]), doc[i], terms.tobytes(), value.astype(np.int32).tobytes()))
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["first", "second", "doc_id", "terms", "grades"])

    def leaf(at: int, rows: list[tuple[int, bytes, bytes]]) -> tuple:
        terms, grades = (np.frombuffer(b"".join(r[j] for r in rows), np.int32) for j in (1, 2))
        ends = np.cumsum([len(r[1]) // 4 for r in rows]).astype(np.int32)
        order = np.lexsort((grades, terms))
        last = np.r_[np.flatnonzero(np.diff(terms[order])), len(order) - 1]
        docs = np.array([r[0] for r in rows], np.int64)
        return at, docs.tobytes(), ends.tobytes(), terms.tobytes(), grades.tobytes(), terms[order][last].tobytes(), grades[order][last].tobytes()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, rows, out = TaskContext.get().partitionId() << 32, 0, [], []
        names = ["leaf", "docs", "ends", "terms", "grades", "max_terms", "max_grades"]
        record = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if j else pa.int64()) for j, x in enumerate(zip(*out))], names)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "grades"))):
                if rows and (len(rows) == LEAF or size + len(row[1]) // 4 > LEAF_TERMS):
                    out.append(leaf(at, rows))
                    at, size, rows = at + 1, 0, []
                rows.append(row)
                size += len(row[1]) // 4
            if out:
                yield record()
                out = []
        if rows:
            out.append(leaf(at, rows))
            yield record()

    few = made.where(F.length("terms") > 0).mapInArrow(placed, "first int, second int, doc_id long, terms binary, grades binary")
    order = ["first", "second", "doc_id"]  # a frequent term is split by the ids of its documents
    binaries = ", ".join(f"{c} binary" for c in ("docs", "ends", "terms", "grades", "max_terms", "max_grades"))
    return materialise(few.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "terms", "grades").mapInArrow(gathered, f"leaf long, {binaries}"), "leaves")


class Node:
    """Items lo .. hi - 1 of the order of the tree: their terms with the largest weight of each."""

    def __init__(self, lo: int, hi: int, terms: np.ndarray, weights: np.ndarray, children: list[Node]):
        self.lo, self.hi, self.terms, self.weights, self.children = lo, hi, terms, weights, children


class ItemTree:
    """The hierarchy of items. numbers: those of the items in the order of the tree."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        self.numbers = np.array(sorted((i for i in range(len(items)) if len(items[i])), key=lambda i: (sorted(items[i].tolist(), key=lambda t: (weights[t], t))[:4], i)), np.int64)
        level = [Node(at, at + 1, np.sort(items[i]), weights[np.sort(items[i])], []) for at, i in enumerate(self.numbers.tolist())]
        self.leaves = level
        while len(level) > 1:
            level = [self._above(level[a : a + FAN]) for a in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    @staticmethod
    def _above(children: list[Node]) -> Node:
        terms, w = np.concatenate([c.terms for c in children]), np.concatenate([c.weights for c in children])
        order = np.lexsort((w, terms))
        last = np.r_[np.flatnonzero(np.diff(terms[order])), len(order) - 1]
        return Node(children[0].lo, children[-1].hi, terms[order][last], w[order][last], children)


class Run:
    """Some leaves side by side and the nodes above them: a matrix of maxima a level, terms by nodes."""

    def __init__(self, maxima: list[tuple[np.ndarray, np.ndarray]]):
        self.terms = np.unique(np.concatenate([t for t, _ in maxima]))
        lowest = np.zeros((len(self.terms), len(maxima)), np.int64)
        for i, (t, g) in enumerate(maxima):
            lowest[np.searchsorted(self.terms, t), i] = g
        self.levels = [lowest]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def bounds(self, node: Node, level: int, at: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.terms, node.terms), len(self.terms) - 1)
        known = self.terms[place] == node.terms
        return node.weights[known] @ self.levels[level][place[known][:, None], at]

    def below(self, at: np.ndarray, level: int) -> np.ndarray:
        children = (at[:, None] * FAN + np.arange(FAN)).ravel()
        return children[children < self.levels[level - 1].shape[1]]

    def open(self, node: Node, floors: np.ndarray, level: int | None = None, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, leaves, bounds) that no bound of a pair of nodes rules out."""
        if level is None:
            level, at = len(self.levels) - 1, np.arange(self.levels[-1].shape[1])
        bound = self.bounds(node, level, at)
        still = bound >= max(int(floors[node.lo : node.hi].min()), 1)
        if not still.any():
            return
        at, bound = at[still], bound[still]
        if not level and not node.children:
            yield node.lo, at, bound
            return
        at = self.below(at, level) if level else at
        for child in node.children or [node]:
            yield from self.open(child, floors, max(level - 1, 0), at)

    def promising(self, node: Node) -> tuple[int, int]:
        """The leaf that the largest bounds of a single item lead to, and its bound."""
        at, best = np.arange(self.levels[-1].shape[1]), 0
        for level in range(len(self.levels) - 1, -1, -1):
            bound = self.bounds(node, level, at)
            best = int(bound.argmax())
            if not level:
                return int(at[best]), int(bound[best])
            at = self.below(at[best : best + 1], level)
        raise AssertionError("a run has a lowest level")


class Leaf:
    """Documents of a leaf and their coordinates, terms by documents."""

    def __init__(self, docs: bytes, ends: bytes, terms: bytes, grades: bytes):
        self.docs, ends = np.frombuffer(docs, np.int64), np.frombuffer(ends, np.int32)
        flat = np.frombuffer(terms, np.int32)
        self.terms, place = np.unique(flat, return_inverse=True)
        self.grades = np.zeros((len(self.terms), len(self.docs)), np.int64)
        self.grades[place, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = np.frombuffer(grades, np.int32)

    def scores(self, node: Node) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.terms, node.terms), len(self.terms) - 1)
        known = self.terms[place] == node.terms
        return node.weights[known] @ self.grades[place[known]]


class Results:
    """The k best documents of each item so far and the scores below which nothing counts."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k = floors.copy(), k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        some = scores >= max(int(self.floors[item]), 1)
        if not some.any():
            return
        have = self.best.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
        score, doc = np.concatenate([have[0], scores[some]]), np.concatenate([have[1], docs[some]])
        order = np.lexsort((doc, -score))[: self.k]
        self.best[item] = score[order], doc[order]
        if len(order) == self.k:
            self.floors[item] = max(int(self.floors[item]), int(score[order[-1]]))

    def rows(self, tree: ItemTree) -> Iterator[pa.RecordBatch]:
        for item, (score, doc) in self.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), tree.numbers[item])), pa.array(doc), pa.array(score)], ["n", "doc_id", "score"])


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[Run, list[tuple]]]:
    """Runs of leaves, with the columns of each."""
    rows: list[tuple] = []
    maxima: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ["max_terms", "max_grades", *columns])):
            top = np.frombuffer(row[0], np.int32), np.frombuffer(row[1], np.int32)
            if rows and (size + len(top[0])) * (len(rows) + 1) > 8 * RUN_CELLS:  # leaves share most of their terms
                yield Run(maxima), rows
                rows, maxima, size = [], [], 0
            rows.append(row[2:])
            maxima.append(top)
            size += len(top[0])
    if rows:
        yield Run(maxima), rows


def floors(index: DataFrame, tree: ItemTree, k: int) -> np.ndarray:
    """For each item of the tree the kth score over its most promising leaves, 0 where they have fewer."""
    shared = index.sparkSession.sparkContext.broadcast(tree)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in _runs(batches, ["leaf"]):
            found = [run.promising(node) for node in shared.value.leaves]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array([rows[at][0] for at, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["item", "leaf", "bound"])

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "leaf"))
    seeds = index.select("leaf", "max_terms", "max_grades").mapInArrow(led, "item long, leaf long, bound long").withColumn("place", place).where((F.col("place") <= SEEDS) & (F.col("bound") > 0))
    seeds = materialise(seeds.groupBy("leaf").agg(F.collect_list("item").alias("items")), "seeds")  # SEEDS leaves an item of the pass

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, *columns in zip(*(batch.column(c).to_pylist() for c in ("items", "docs", "ends", "terms", "grades"))):
                leaf, results = Leaf(*columns), Results(np.zeros(len(shared.value.leaves), np.int64), k)
                for item in items:
                    results.add(item, leaf.scores(shared.value.leaves[item]), leaf.docs)
                for item, (score, _) in results.best.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(score)], ["item", "score"])

    known = index.join(F.broadcast(seeds), "leaf").select("items", "docs", "ends", "terms", "grades").mapInArrow(scored, "item long, score long")
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    out = np.zeros(len(tree.leaves), np.int64)
    for item, score in known.withColumn("place", best).where(F.col("place") == k).select("item", "score").collect():
        out[item] = score
    discard(seeds)
    return out


def _searched(index: DataFrame, tree: ItemTree, first: np.ndarray, k: int) -> DataFrame:
    """(n, doc_id, score): what each task finds for the items."""
    shared = index.sparkSession.sparkContext.broadcast((tree, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first = shared.value
        results = Results(first, k)
        for nodes, rows in _runs(batches, ["docs", "ends", "terms", "grades"]):
            made: dict[int, Leaf] = {}
            for item, at, bound in nodes.open(tree.root, results.floors):
                for i in np.argsort(-bound, kind="stable").tolist():
                    if bound[i] < results.floors[item]:
                        break
                    leaf = made.get(int(at[i])) or made.setdefault(int(at[i]), Leaf(*rows[at[i]]))
                    results.add(item, leaf.scores(tree.leaves[item]), leaf.docs)
        yield from results.rows(tree)

    return index.mapInArrow(run, "n long, doc_id long, score long")


def _of_pass(docs: DataFrame, some: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(n, rank, doc_id, score) of the items of a pass, by their place in it."""
    number: dict[bytes, int] = {}
    items = [np.array([number.setdefault(bytes(t), len(number)) for t in r["terms"]], np.int32) for r in some]
    made = profiles(docs, number, id_col, text_col)
    n_docs, n_terms = made.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = document_counts(made, len(number))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) if df else 0 for df in held], np.int64)
    tree = ItemTree([i[weights[i] > 0] for i in items], weights)
    if tree.root is None:
        return None
    index = leaves(made, weights, n_docs, n_terms)
    discard(made)
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "doc_id"))
    return _searched(index, tree, floors(index, tree, k), k).withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", per_pass: int = TERMS_A_PASS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    asked = item_terms(items, item_col, item_text_col)
    kind = asked.schema["item_id"].dataType.simpleString()
    passes = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // per_pass))
    out = []
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).orderBy("row").collect()
        found = _of_pass(docs, some, k, id_col, text_col) if some else None
        if found is not None:
            ids = F.broadcast(spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(some)], f"n long, item_id {kind}"))
            out.append(found.join(ids, "n").select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))
    discard(asked)
    if not out:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    return reduce(DataFrame.union, out)
