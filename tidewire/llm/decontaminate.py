"""Benchmark decontamination: windows of benchmark words found in documents.

A benchmark of checked size becomes one broadcast hash set of word windows; tasks scan the
token windows of their documents against it and verify every hit word by word, so documents
never move. Beyond BROADCAST_WORDS benchmark words the windows of documents are joined to
those of the benchmark by a 128-bit key instead.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is WINDOW
consecutive words of an item, or all words of a shorter item. A document word inside any
occurrence of a window is hit; a document is contaminated if a word is hit and 20 times the
hit words are at least all words.

Defined results: null and empty texts have no words and are clean; an item without words or
without an id takes no part; an id on several rows counts once; an empty benchmark leaves
every document clean; repeated documents are judged each on its own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, materialise, others

WINDOW = 13
#: Most benchmark words that are broadcast (about 150 bytes each in a worker).
BROADCAST_WORDS = 1_000_000
#: Lower-cases A-Z and turns every byte that is in no word to a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DIGEST = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


def _windows(words: list[bytes]) -> list[list[bytes]]:
    size = min(WINDOW, len(words))
    return [words[i : i + size] for i in range(len(words) - size + 1)] if words else []


class WindowSet:
    """Hash set of the windows of all items, by length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            for window in _windows(words_of(text or "")):
                key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in window)
                found.setdefault(len(key), {}).setdefault(key, set()).add(item)
        self.by_length = {}
        for size, windows in found.items():
            keys = np.array(list(windows), np.int32).reshape(len(windows), size)
            seed = 1
            while len(np.unique(hashes := self._hash(keys, seed))) < len(keys):
                seed += 1
            order = np.argsort(hashes)
            owners = [sorted(windows[tuple(keys[i].tolist())]) for i in order]
            self.by_length[size] = seed, hashes[order], keys[order], owners

    @staticmethod
    def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
        h = np.full(len(keys), seed, np.uint64)
        for j in range(keys.shape[1]):
            h = (h ^ keys[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Which words are hit (all documents in one array, one gap after each), where each document starts, its items."""
        sizes = np.array([len(d) for d in docs], np.int64)
        start = np.r_[0, np.cumsum(sizes + 1)]
        ids = np.full(start[-1] + WINDOW, -1, np.int32)
        get = self.vocabulary.get
        for at, words in zip(start.tolist(), docs):
            ids[at : at + len(words)] = [get(w, -1) for w in words]
        unknown = np.r_[0, np.cumsum(ids < 0)]
        cover = np.zeros(len(ids) + 1, np.int64)
        items: list[set[int]] = [set() for _ in docs]
        for size, (seed, hashes, keys, owners) in self.by_length.items():
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            grams = ids[at[:, None] + np.arange(size)]
            h = self._hash(grams, seed)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[slot] == h
            at, slot, grams = at[hit], slot[hit], grams[hit]
            same = (grams == keys[slot]).all(axis=1)  # verified word by word
            at, slot = at[same], slot[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            doc = np.searchsorted(start, at, side="right") - 1
            for d, s in np.unique(np.c_[doc, slot], axis=0).tolist():
                items[d].update(owners[s])
        return np.cumsum(cover)[:-1] > 0, start, items


def _digest(n_words: list[int], n_hit: list[int], items: list) -> list:
    listed = [",".join(sorted(map(str, x))) for x in items]
    return [
        n_words,
        n_hit,
        [len(set(x)) for x in items],
        [hashlib.sha256(x.encode()).hexdigest() for x in listed],
        [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)],
    ]


def _benchmark(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")


def _fits(items: DataFrame, limit: int) -> bool:
    """Whether the benchmark has at most `limit` words, counted in Spark (a word has a byte and a gap at least)."""
    total = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    return total <= limit


def _windowset(spark, items: DataFrame):
    return spark.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()]))


def annotate(docs: DataFrame, benchmark: DataFrame, prefix: str = "", limit: int = BROADCAST_WORDS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated, each name after `prefix`."""
    items = _benchmark(benchmark)
    fields = ", ".join(prefix + f for f in DIGEST.split(", "))
    if not _fits(items, limit):
        return _annotate_joined(docs, items, prefix, fields)
    windows = _windowset(docs.sparkSession, items)

    def start():
        found = windows.value

        def made(texts: list[str]) -> list:
            split = [words_of(t) for t in texts]
            hit, at, owned = found.scan(split)
            n_hit = np.add.reduceat(hit, at[:-1]).tolist()
            return _digest([len(w) for w in split], n_hit, owned)

        return made

    return append(docs, "text", fields, start)


def remove_documents(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """docs without the contaminated ones."""
    return annotate(docs, benchmark, "__tw_", limit).where("NOT __tw_contaminated").select(*docs.columns)


def _without(text: str, hit: np.ndarray) -> str:
    """A text without its runs of hit words."""
    if not hit.any():
        return text
    raw, kept, last, inside = text.encode(), [], 0, False
    for m, h in zip(re.finditer(rb"[^ ]+", raw.translate(TO_WORDS)), hit.tolist()):
        if h and not inside:
            kept.append(raw[last : m.start()])
        if h:
            last = m.end()
        inside = h
    return b"".join([*kept, raw[last:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """docs whose texts lose every run of hit words, from its first to its last character."""
    items = _benchmark(benchmark)
    if not _fits(items, limit):
        return _remove_joined(docs, items)
    windows = _windowset(docs.sparkSession, items)

    def start():
        found = windows.value

        def made(texts: list[str]) -> list:
            split = [words_of(t) for t in texts]
            hit, at, _ = found.scan(split)
            return [[_without(t, hit[a : a + len(w)]) for t, w, a in zip(texts, split, at.tolist())]]

        return made

    made = append(docs, "text", "__tw_clean string", start)
    return made.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__tw_clean"))).select(*docs.columns)


def _remove_joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    schema = docs.schema
    at = schema.names.index("text")
    found = _hits_joined(docs, items).select(*docs.columns, "__tw_spans")

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__tw_spans").to_pylist()):
                hit = np.zeros(len(words_of(text or "")), bool)
                for s in spans:
                    hit[s["at"] : s["at"] + s["size"]] = True
                texts.append(None if text is None else _without(text, hit))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(schema))], schema.names)

    return found.mapInArrow(run, schema)


def _hits_joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with __tw_row, __tw_spans (at, size) and __tw_items, for a benchmark of any size.

    Windows of both sides meet in a join by a 128-bit key of their words.
    """

    def keyed(sizes):
        def start():
            def made(texts: list[str]) -> list:
                out = []
                for t in texts:
                    w = words_of(t)
                    some = sizes or [min(WINDOW, len(w))]
                    out.append([{"key": xxhash.xxh3_128_digest(b" ".join(w[i : i + n])), "at": i, "size": n} for n in some if n for i in range(len(w) - n + 1)])
                return [pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array(out, pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int32()), ("size", pa.int32())])))]

            return made

        return start

    shape = "__tw_n bigint, __tw_w array<struct<key: binary, at: int, size: int>>"
    bench = append(items, "text", shape, keyed(None)).select("item_id", F.explode("__tw_w").alias("w")).select("item_id", "w.key", "w.size").distinct()
    bench = bench.groupBy("key", "size").agg(F.collect_set("item_id").alias("items"))
    sizes = [r[0] for r in bench.select("size").distinct().collect()]
    rows = materialise(docs.withColumn("__tw_row", F.monotonically_increasing_id()), "decontaminate")
    spread = append(rows.select("__tw_row", "text"), "text", shape, keyed(sizes))
    hits = spread.select("__tw_row", F.explode("__tw_w").alias("w")).select("__tw_row", "w.*").join(bench, ["key", "size"])
    hits = hits.groupBy("__tw_row").agg(F.collect_set(F.struct("at", "size")).alias("__tw_spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__tw_items"))
    return rows.join(hits, "__tw_row", "left").withColumns({c: F.coalesce(c, F.array().cast(dict(hits.dtypes)[c])) for c in ("__tw_spans", "__tw_items")})


def _annotate_joined(docs: DataFrame, items: DataFrame, prefix: str, fields: str) -> DataFrame:
    out = _hits_joined(docs, items)

    def start():
        return lambda texts: [[len(words_of(t)) for t in texts]]

    out = append(out, "text", "__tw_words bigint", start)
    at = F.flatten(F.transform("__tw_spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    hit = F.size(F.array_distinct(at)).cast("bigint")
    listed = F.array_join(F.array_sort(F.transform("__tw_items", lambda x: x.cast("string"))), ",")
    made = [F.col("__tw_words"), hit, F.size("__tw_items").cast("bigint"), F.sha2(listed, 256), (hit > 0) & (20 * hit >= F.col("__tw_words"))]
    names = [f.split()[0] for f in fields.split(", ")]
    return out.select(*others(docs, names, "text"), *(c.alias(f.split()[0]) for c, f in zip(made, fields.split(", "))))
