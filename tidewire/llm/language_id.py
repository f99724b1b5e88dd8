"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree of variable order up to ORDER. Its statistics are
counted by Spark over a bounded sample of labelled rows and then frozen. The code length of
a text under a language is exact: at each byte the longest context that the tree has codes
the byte, or an escape (method C, with exclusions) down to a shorter context, down to equal
shares of the bytes never seen. The language with the shortest code wins.

Each language holds a row of code lengths for each context it has seen, one column a byte, and
all languages share the way from the last ORDER bytes to a context; so a text is scored with a
few numpy look-ups at all its positions at once.

Texts are lower-cased and everything but letters becomes one space. SAMPLE_DOCS labelled
rows a language (those with the smallest hash of their id) bound the fit; every context of
these rows is in the tree.

Defined results: `und` and score 0 for a null text or one without a letter, and for every
text if no row is labelled; equal code lengths go to the language first in order; labels
that are null are not learned from; rows are independent.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append, bound_batches

ORDER = 3
SAMPLE_DOCS = 300
MARGIN = 4
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    """The letters of a text, lower-cased, in words one space apart."""
    line = " ".join(LETTERS.findall(text.lower()))
    if not any(map(str.isalpha, line)):
        return b""
    return line.encode()


def sample(docs: DataFrame, label_col: str, id_col: str, per_label: int = SAMPLE_DOCS) -> DataFrame:
    """At most per_label labelled rows of each label, the same ones at any partitioning.

    They are those with the smallest hash of their id. Of a label with more rows only a share
    that holds about MARGIN times as many is ranked, so a frequent label costs no more.
    """
    ids = docs.where(F.col(label_col).isNotNull() & F.col("text").isNotNull()).select(id_col, label_col)
    share = ids.groupBy(label_col).agg((F.lit(float(MARGIN * per_label)) / F.count(F.lit(1))).alias("__tw_share"))
    hashed = F.xxhash64(F.col(id_col).cast("string"))
    place = (hashed.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    ids = ids.join(F.broadcast(share), label_col).where(place <= F.col("__tw_share"))
    first = Window.partitionBy(label_col).orderBy(hashed, id_col)
    ids = ids.withColumn("__tw_n", F.row_number().over(first)).where(F.col("__tw_n") <= per_label).select(id_col).distinct()
    return docs.join(F.broadcast(ids), id_col, "left_semi").where(F.col(label_col).isNotNull())


def count_contexts(rows: DataFrame, label_col: str, order: int = ORDER) -> DataFrame:
    """(label, length, context, byte, n): how often a byte follows a context of that length.

    A context is its bytes as a number; a text starts after zero bytes.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            parts = defaultdict(list)
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts[label].append(letters_of(text or ""))
            for label, texts in parts.items():
                b = np.frombuffer(b"".join(bytes(order) + t for t in texts), np.uint8).astype(np.int64)
                for length in range(order + 1):
                    key = b[order:].copy()
                    for j in range(1, length + 1):
                        key |= b[order - j : -j] << (8 * j)
                    key, n = np.unique(key[b[order:] > 0], return_counts=True)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"label": label, "length": np.int32(length), "context": key >> 8, "byte": (key & 255).astype(np.int32), "n": n}), preserve_index=False)

    bound_batches(rows.sparkSession)
    counts = rows.select(F.col(label_col).cast("string"), "text").mapInArrow(run, "label string, length int, context long, byte int, n long")
    return counts.groupBy("label", "length", "context", "byte").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen trees of all languages as tables of code lengths."""

    def __init__(self, labels: list[str], counts: dict[str, np.ndarray], order: int = ORDER):
        """counts: arrays label (index), length, context, byte, n."""
        self.labels, self.order = labels, order
        seen = np.unique(np.r_[0, counts["byte"]])  # 0 stands before the start
        #: Bytes in classes; class 0 is every byte never seen.
        self.class_of = np.zeros(256, np.int32)
        self.class_of[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.unseen = 256 - len(seen)
        key = (counts["length"].astype(np.int64) << 56) | counts["context"]
        contexts = np.unique(np.r_[key, 0])  # the longer ones come later
        #: For each language and context the row of its longest context; rows are those it has seen.
        self.row, tables, rows = np.zeros((len(labels), len(contexts)), np.int32), [], 0
        for k in range(len(labels)):
            mine = counts["label"] == k
            own, table = self._table(key[mine], self.class_of[counts["byte"][mine]], counts["n"][mine])
            self.row[k] = rows + self._longest(own, contexts)
            tables.append(table)
            rows += len(own)
        self.bits = np.concatenate(tables).astype(np.float32).reshape(-1)
        self.context_of = np.zeros((self.width,) * order, np.int32)
        for i, c in enumerate(contexts.tolist()):
            # bytes of the context from the oldest to the latest, then their classes
            cls = tuple(int(self.class_of[(c >> (8 * j)) & 255]) for j in range((c >> 56) - 1, -1, -1))
            self.context_of[(..., *cls)] = i

    def _longest(self, own: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """For each context the place in `own` of its longest end that is there."""
        out = np.full(len(contexts), -1)
        for n in range(self.order, -1, -1):
            end = (np.int64(n) << 56) | (contexts & ((np.int64(1) << (8 * n)) - 1))
            at = np.minimum(np.searchsorted(own, end), len(own) - 1)
            out = np.where((out < 0) & (own[at] == end) & (contexts >> 56 >= n), at, out)
        return out

    def _table(self, key: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(contexts of a language, bits of every class after each): its counts, then escapes to ever shorter contexts."""
        own, at = np.unique(key, return_inverse=True)
        count = np.zeros((len(own), self.width))
        np.add.at(count, (at, cls), n)
        bits, spent, open_ = np.full(count.shape, np.nan), np.zeros(len(own)), np.ones(count.shape, bool)
        for m in range(self.order, -1, -1):
            long = np.flatnonzero(own >> 56 >= m)  # a context is seen wherever a longer one is
            end = np.searchsorted(own, (np.int64(m) << 56) | (own[long] & ((np.int64(1) << (8 * m)) - 1)))
            here = np.where(open_[long], count[end], 0)
            total, kinds = here.sum(1), np.count_nonzero(here, axis=1)
            got = here > 0
            all_ = np.maximum(total + kinds, 1)[:, None]
            with np.errstate(divide="ignore"):
                bits[long] = np.where(got, spent[long][:, None] - np.log2(here / all_), bits[long])
            spent[long] -= np.log2(np.where(kinds > 0, kinds / all_[:, 0], 1))
            open_[long] &= ~got
        left = open_[:, 1:].sum(1) + self.unseen
        return own, np.where(open_, (spent + np.log2(np.maximum(left, 1)))[:, None], bits)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (no empty ones) under each language."""
        pad = bytes(self.order)
        b = self.class_of[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)]
        state = np.zeros(len(b) - self.order, np.int32)
        for j in range(self.order):
            state *= self.width
            state += b[j : len(state) + j]
        context, last = self.context_of.reshape(-1)[state], b[self.order :]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.r_[0, np.cumsum(sizes[:-1] + self.order)]
        cuts = np.c_[begin, begin + sizes].reshape(-1)  # a text, then the start of the next
        if cuts[-1] == len(state):
            cuts = cuts[:-1]
        out = []
        for row in self.row:
            place = row[context]
            place *= self.width
            place += last
            out.append(np.add.reduceat(self.bits[place], cuts, dtype=np.float64)[::2])
        return np.array(out).T


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", per_label: int = SAMPLE_DOCS, order: int = ORDER) -> ContextTrees | None:
    """Trees of the labels of docs, from at most per_label rows of each; None without labelled rows.

    What comes to the driver are the counts of the bounded sample.
    """
    counts = count_contexts(sample(docs, label_col, id_col, per_label), label_col, order).toPandas()
    if counts.empty:
        return None
    labels = sorted(counts["label"].unique())
    columns = {c: counts[c].to_numpy() for c in ("length", "context", "byte", "n")}
    return ContextTrees(labels, columns | {"label": counts["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()}, order)


def predict(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score: the posterior of the best language by code lengths, equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def start():
        model = shared.value

        def made(texts: list[str]) -> list:
            lines = [letters_of(t) for t in texts]
            some = [i for i, x in enumerate(lines) if x]
            best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if some and model:
                bits = model.score([lines[i] for i in some])
                first = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
                for i, k, s in zip(some, first.tolist(), share.tolist()):
                    best[i], score[i] = model.labels[k], s
            return [best, score]

        return made

    return append(docs, text_col, f"{prefix}lang_pred string, {prefix}score double", start)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
