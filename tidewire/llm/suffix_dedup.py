"""Removal of repeated 200-byte passages by distributed prefix doubling, over sampled positions.

Spark ranks positions by what they cover, at growing offsets: pairs (rank, rank at an offset)
are grouped, equal pairs become a rank of the next round, positions whose rank is unique drop
out, and a position is done once its rank covers LENGTH bytes. Ranks are names of bytes (equal
bytes, equal names), so the rank at an offset is read from the position's own text instead of
joined from another row; what decides is always a pair, 128 bits together.

A row a byte and round would write 24 bytes and more for each byte. So the first rounds run on
sampled positions: of each LENGTH-byte string the leftmost one with the smallest SEED-byte name.
Equal strings have it at equal places, and neighbouring starts with the same one form a run.

1. SEED bytes: runs ranked by their seed. Unique ranks drop out with all their starts.
2. All bytes of a run: pairs (seed, name of all that its strings cover). If two runs share a
   pair, all their starts are repeated and done; one of them stays as a partner of others.
3. SEED + SIDE bytes: what is left of groups with several such pairs is ranked by the seed and
   the bytes next to it, to the right for strings with more there, else to the left. Unique
   pairs drop out.
4. LENGTH bytes: pairs (rank of 3, name of the string) of every single start that is left.

Every round is a groupBy with partial counts, written to the shared folder before it is joined
back, so a hot rank is split by Spark and no task holds a group. Texts don't move unless the
rows to look up or the spans found exceed BROADCAST_BYTES; then they are joined by document.

Defined results: texts are UTF-8 bytes, null is empty; a string also repeats if its other
start is in the same document, overlapping or not; rows that share an id, or have none, are
documents each; columns other than the id and the text are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, identified, materialise

LENGTH = 200
SEED = 64
WINDOW = LENGTH - SEED + 1
#: Bytes next to the seed that a string has on one side at least.
SIDE = (LENGTH - SEED) // 2
#: Bits of a position inside a segment; a document longer than a segment is cut to several.
PLACE = 20
SEGMENT = (1 << PLACE) - 1
CHUNK_BYTES = 4_000_000
#: Rows that a task holds before they leave as a batch.
ROWS_HELD = 5_000
#: Most bytes of spans or of runs to look up that are broadcast to the texts, and bytes of one as Spark holds it.
BROADCAST_BYTES = 64_000_000
SPAN_BYTES, LOOK_BYTES = 8, 56
SPREAD = 0x9E3779B97F4A7C15


def seed_names(data: np.ndarray) -> np.ndarray:
    """64-bit names of all SEED-byte strings of data, by doubling their length."""
    names = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD)
    n = 1
    while n < SEED:
        right = names[n:]
        names = names[:-n] * np.uint64(pow(SPREAD, 2 * n + 1, 1 << 64)) + (right ^ (right >> np.uint64(31)))
        names *= np.uint64(0xD6E8FEB86659FD93)
        n *= 2
    return names ^ (names >> np.uint64(32))


def runs(segments: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """(first start, number of starts, offset of the seed in the first, name of the seed) of each segment's runs.

    Segments have LENGTH to SEGMENT bytes.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    names = seed_names(data)
    begin = np.r_[0, np.cumsum([len(s) for s in segments])]
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(begin[:-1], np.diff(begin)).astype(np.uint64)
    least = ((names >> np.uint64(PLACE)) << np.uint64(PLACE)) | place[: len(names)]
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        m = least[a : b - LENGTH + 1]
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        seed = (m[first] & np.uint64(SEGMENT)).astype(np.int64)
        out.append((first, np.diff(np.r_[first, len(m)]), seed - first, names[a + seed]))
    return out


def _segments(data: bytes) -> list[tuple[int, bytes]]:
    """(place, bytes): parts in which each LENGTH-byte string starts exactly once."""
    step = SEGMENT - LENGTH + 1
    return [(i, data[i : i + SEGMENT]) for i in range(0, max(1, len(data) - LENGTH + 1), step)] if len(data) >= LENGTH else []


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def seed_runs(docs: DataFrame) -> DataFrame:
    """(doc, at, n, off, v, e) of every run: its starts, its seed's offset and name, the name of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for (doc, place, data), (at, n, off, v) in zip(held, runs([d for _, _, d in held])):
                name = xxhash.xxh3_64_intdigest
                e = np.array([name(data[a:b]) for a, b in zip(at.tolist(), (at + n - 1 + LENGTH).tolist())], np.uint64)
                for c, x in zip(columns, (np.full(len(at), doc), at + place, n, off, _signed(v), _signed(e))):
                    c.append(x)
            arrays = [pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc", "at", "n", "off", "v", "e"])

        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, part in _segments((text or "").encode()):
                    held.append((doc, place, part))
                    size += len(part)
                    if size >= CHUNK_BYTES:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    return docs.select("doc", "text").mapInArrow(run, "doc long, at long, n int, off int, v long, e long")


def _with_text(docs: DataFrame, found: DataFrame, size: int, how: str, limit: int) -> DataFrame:
    """docs joined to a table with one row a document; that table is broadcast if its `size` in bytes is within the limit."""
    return docs.join(F.broadcast(found) if size <= limit else found, "doc", how)


def _side_rows(texts: DataFrame) -> DataFrame:
    """(key, doc, at, names, mine): round 3's parts of the runs in the column `look`, with the names of their starts for round 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh3_64_intdigest

        def made(out: list[tuple]) -> pa.RecordBatch:
            key, doc, at, size, names, mine = map(list, zip(*out))
            starts = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            flat = pa.array(_signed(np.array([x for n in names for x in n], np.uint64)))
            arrays = [pa.array(_signed(np.array(key, np.uint64))), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.ListArray.from_arrays(starts, flat), pa.array(mine, pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, ["key", "doc", "at", "names", "mine"])

        for batch in batches:
            out: list[tuple] = []
            for doc, text, look in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "look"))):
                data = text.encode()
                for x in look:
                    at, seed, end = x["at"], x["at"] + x["off"], x["at"] + x["n"]
                    cut = min(max(at, seed - SIDE), end)  # strings that start before it have SIDE bytes left of the seed
                    for a, b, side, near in ((at, cut, 0, data[seed - SIDE : seed]), (cut, end, 1, data[seed + SEED : seed + SEED + SIDE])):
                        if a < b:
                            key = name(near, seed=x["v"] & (2**64 - 1)) ^ side
                            out.append((key, doc, a, b - a, [name(data[i : i + LENGTH]) for i in range(a, b)], x["mine"]))
                    if len(out) >= ROWS_HELD:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return texts.mapInArrow(run, "key long, doc long, at long, names array<bigint>, mine boolean")


def repeated_starts(docs: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, at, n): runs of starts of LENGTH-byte strings that also start elsewhere. docs: doc (a unique id) and text."""
    many = F.count(F.lit(1)).alias("c")
    runs_ = materialise(seed_runs(docs), "seed-runs")
    seeds = materialise(runs_.groupBy("v").agg(many).where("c > 1").select("v"), "seeds")
    live = materialise(runs_.join(seeds, "v", "left_semi"), "live-runs")
    discard(runs_, seeds)

    ranks = materialise(live.groupBy("v", "e").agg(many, F.min(F.struct("doc", "at", "n", "off")).alias("first")), "run-ranks")
    done = live.join(ranks.where("c > 1").select("v", "e"), ["v", "e"], "left_semi").select("doc", "at", "n")

    open_ = materialise(ranks.groupBy("v").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 AND kinds > 1").select("v"), "open-seeds")
    look = ranks.join(open_, "v", "left_semi").select("v", "first.*", (F.col("c") == 1).alias("mine"))
    look = materialise(look.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "off", "v", "mine")).alias("look")), "look-up")
    size = LOOK_BYTES * (look.agg(F.sum(F.size("look"))).first()[0] or 0)
    sides = materialise(_side_rows(_with_text(docs.select("doc", "text"), look, size, "inner", limit)), "sides")

    keys = materialise(sides.groupBy("key").agg(many, F.max("mine").alias("any")).where("c > 1 AND any").select("key"), "side-ranks")
    live_sides = materialise(sides.join(keys, "key", "left_semi"), "live-sides")
    discard(look, sides, keys)
    starts = live_sides.select("key", "doc", "at", "mine", F.posexplode("names").alias("i", "name"))
    whole = materialise(starts.groupBy("key", "name").agg(many, F.max("mine").alias("any")).where("c > 1 AND any").select("key", "name"), "start-ranks")
    starts = starts.where("mine").select("key", "name", "doc", (F.col("at") + F.col("i")).alias("at"))
    return done.union(starts.join(whole, ["key", "name"], "left_semi").select("doc", "at", F.lit(1).alias("n")))


def _merged(rows: DataFrame) -> DataFrame:
    """(doc, spans): maximal removed runs of bytes of each document, as alternating begins and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows, begin = batch.column("x").flatten(), np.r_[0, np.cumsum(batch.column("x").value_lengths().to_numpy())].tolist()
            at, n = rows.field("at").to_numpy(), rows.field("n").to_numpy()
            for i, j in zip(begin, begin[1:]):
                order = np.argsort(at[i:j], kind="stable")
                start = at[i:j][order]
                end = np.maximum.accumulate(start + n[i:j][order] - 1 + LENGTH)
                first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                last = np.r_[first[1:] - 1, len(start) - 1]
                out.append(np.c_[start[first], end[last]].reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.list_(pa.int64()))], ["doc", "spans"])

    grouped = rows.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("x"))
    return grouped.mapInArrow(run, "doc long, spans array<bigint>")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document.

    kept_sha256 is over the remaining bytes; spans holds begins and ends of the removed runs.
    """
    rows = identified(docs, id_col, text_col)
    spans = materialise(_merged(repeated_starts(rows, limit)), "removed-spans")
    size = spans.agg(F.sum(SPAN_BYTES * F.size("spans") + LOOK_BYTES)).first()[0] or 0
    joined = _with_text(rows, spans, size, "left", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, kept = [], [], []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode()
                edge = [0, *(cut or ()), len(data)]
                digest = hashlib.sha256()
                for a, b in zip(edge[::2], edge[1::2]):
                    digest.update(data[a:b])
                size.append(len(data))
                removed.append(sum(cut[1::2]) - sum(cut[::2]) if cut else 0)
                kept.append(digest.hexdigest())
            out = [batch.column("id"), *map(pa.array, (size, removed)), pa.array([len(c or ()) // 2 for c in batch.column("spans").to_pylist()], pa.int64()), pa.array(kept), batch.column("spans")]
            yield pa.RecordBatch.from_arrays(out, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return joined.mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
