"""SimHash near-dedup by tiled exact comparison.

A document's fingerprint has a bit set where over half the XXH64 values (seed 42) of its
4-word shingles have it. Fingerprints that differ in at most RADIUS bits are linked; linked
documents form components.

Only distinct fingerprints are compared. Two fingerprints within RADIUS bits agree on one
of RADIUS + 1 blocks of bits (there are more blocks than differences), so each fingerprint
goes to one group a block, by as many of the block's bits as leave about GROUP fingerprints in a
group; few fingerprints are one group. A group is cut to tiles of fingerprints by population
count, of TILE between tasks and of FINE inside one; pairs of tiles whose population counts
differ beyond the radius are skipped, all others are compared exactly, in numpy, by
exclusive-or and bit counts. A tile pair returns the stars of its linked fingerprints (at most
one edge a fingerprint), not the pairs. Nothing is approximate and nothing is capped: a large
group only has more tiles.

Words: A-Z lower-cased, then `[^\\x20\\x09-\\x0D]+`; shingles keep repeats and are joined
by one space; fewer words than a shingle are one shingle; no words: fingerprint zero, linked
like any other.

Defined results: null and empty texts have fingerprint zero; component_id is the smallest id
of the component, nulls left out (null if it has no other); repeated rows are each returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append, materialise, unique_ids
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a group that blocks aim at, of a tile between tasks, of a tile inside a task.
GROUP, TILE, FINE = 2048, 4096, 64
BROADCAST_IDS = 2_000_000
#: bytes.split() also splits at 0x1C-0x1F, which are not among the separators.
SPACES = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 values of the shingles of one text."""
    words = [w for w in text.encode().translate(SPACES).split(b" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
    ends = (starts[shingle:] if len(words) >= shingle else starts[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    return print_of(hashes(text, shingle))


def print_of(h: np.ndarray) -> int:
    """The 64-bit fingerprint of some hashes."""
    n = len(h)
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        set_ += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with its fingerprints as signed 64-bit integers."""

    def start():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64).tolist()]

    return append(docs, text_col, f"{out_col} bigint", start)


def _blocks(radius: int, n: int, group: int) -> list[tuple[int, int]]:
    """(shift, mask) of the bits that deal n fingerprints out, for each of radius + 1 blocks of 64 bits; one group if they are few."""
    bits = max(0, n - 1).bit_length() - max(1, group).bit_length() + 1
    if n <= group:
        return [(0, 0)]
    cuts = np.linspace(0, 64, radius + 2).round().astype(int).tolist()
    return [(a, (1 << min(b - a, max(1, bits))) - 1) for a, b in zip(cuts, cuts[1:])]


def tile_pairs(pop: np.ndarray, fine: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i <= j: tiles of fingerprints in the order of their population counts that can hold a link."""
    low, high = pop[::fine], np.maximum.reduceat(pop, np.arange(0, len(pop), fine)) if len(pop) else pop
    last = np.searchsorted(low, high + radius, side="right")  # tiles that begin within the radius of this one's end
    first = np.arange(len(low))
    return np.repeat(first, last - first), np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(low) else first


def _stars(prints: np.ndarray, second: np.ndarray | None, radius: int, fine: int = FINE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller) that connect just what pairs of prints link; with `second` only pairs of unequal marks count."""
    pop = np.bitwise_count(prints).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    x, pop = prints[order], pop[order]
    mark = None if second is None else second[order]
    left, right = [], []
    for i, j in zip(*(t.tolist() for t in tile_pairs(pop, fine, radius))):
        a, b = np.nonzero(np.bitwise_count(x[i * fine : (i + 1) * fine, None] ^ x[None, j * fine : (j + 1) * fine]) <= radius)
        a, b = a + i * fine, b + j * fine
        keep = a < b
        if mark is not None:
            keep &= mark[a] != mark[b]
        left.append(a[keep])
        right.append(b[keep])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    # labels flow along the links until each is the smallest fingerprint of its component
    values = x.view(np.int64)
    label = values.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == label).all():
            break
        label = new
    keep = label != values
    return values[keep], label[keep]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) with the components of all links."""
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)).alias("value")) for i, (s, m) in enumerate(_blocks(radius, prints.count(), group))))
    spread = prints.select("fp", F.bit_count("fp").alias("pop"), F.explode(blocks).alias("b")).select("b.block", "b.value", "pop", "fp")
    # How many tiles each population count of a group needs; the table has at most (radius + 1) x 2^13 x 65 rows.
    sizes = spread.groupBy("block", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    whole_group = Window.partitionBy("block", "value")
    sizes = sizes.withColumn("all", F.sum("n").over(whole_group)).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    whole = F.col("all") <= tile
    sizes = sizes.withColumn("pops", F.collect_list(F.struct("pop", "tiles")).over(whole_group))
    spread = spread.join(sizes, ["block", "value", "pop"])
    part = F.when(whole, F.lit("")).otherwise(F.format_string("%d.%d", "pop", F.pmod(F.xxhash64("fp"), F.col("tiles"))))
    # A tile meets itself, the other tiles of its population count and those up to `radius` counts away.
    near = F.filter("pops", lambda p: F.abs(p["pop"] - F.col("pop")) <= radius)
    partners = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), p["tiles"] - 1), lambda i: F.format_string("%d.%d", p["pop"], i))))
    partners = F.when(whole, F.array(F.lit(""))).otherwise(partners)
    spread = spread.select("block", "value", "fp", part.alias("part"), F.explode(partners).alias("with"))
    spread = spread.select("block", "value", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"), (F.col("part") > F.col("with")).alias("second"), "fp")

    dealt = spread.repartition("block", "value", "x", "y").sortWithinPartitions("block", "value", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["block", "value", "x", "y"]):
            fp, second = rows["fp"].to_numpy().view(np.uint64), rows["second"].to_numpy(zero_copy_only=False)
            if len(fp) > 1:
                same = rows["x"][0] == rows["y"][0]
                if not same and second.all() == second.any():
                    continue  # the other tile is empty
                u, v = _stars(fp, None if same else second, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows that batches in the order of their keys hold, one at a time.

    A group's rows are those of two tiles at most, so what is carried over is bounded.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist()]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)
        held = [batch.slice(cuts[-1])]
    for batch in held:
        yield batch


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    fp = materialise(fingerprints(docs.select(id_col, text_col), text_col, "fp", shingle).select(id_col, "fp"), "fingerprints")
    least = materialise(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    root = components(links(least.select("fp"), radius))
    named = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fp.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", annotate: Callable[..., DataFrame] = annotate) -> DataFrame:
    """docs with one document of each component that annotate tells: the one with the smallest id.

    Ids that are null come after all others; of rows that tie one is kept. The ids that go
    are broadcast if they are at most BROADCAST_IDS, else the texts are shuffled once.
    """
    if unique_ids(docs, id_col):
        gone = annotate(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col)
        rows, row = docs, id_col
    else:
        row = "__tw_row"
        rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        marked = annotate(rows, row, text_col).join(rows.select(row, F.col(id_col).alias("__tw_id")), row)
        first = marked.groupBy("component_id").agg(F.min(F.struct(F.col("__tw_id").isNull().alias("a"), F.col("__tw_id").alias("b"), F.col(row).alias("c"))).alias("first"))
        gone = marked.join(first, "component_id").where(F.col(row) != F.col("first.c")).select(row)
    gone = materialise(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, row, "left_anti").select(*docs.columns)
