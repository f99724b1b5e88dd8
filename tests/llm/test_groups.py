"""Operators over all documents, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import components, line_dedup, simhash

ODD = [None, "", " ", "one", "one two three", "a\x1cb c d e f"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcde", k=4))
    base = [[word() for _ in range(120)] for _ in range(6)]
    texts = list(ODD)
    for b in base:
        for _ in range(25):
            t = list(b)
            for _ in range(random.choice([0, 0, 1, 2])):
                t[random.randrange(len(t))] = word().upper()
            texts.append(" \n".join(t))
    prints = [print_by_hand(t) for t in texts]
    assert [simhash.fingerprint(t or "") for t in texts] == prints
    want = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    rows = simhash.annotate(frame(spark, texts)).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {i: (prints[i], want[i]) for i in range(len(texts))}
    kept = simhash.keep_first(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "source"] and {r[0] for r in kept.collect()} == set(want.values())
    assert simhash.annotate(frame(spark, []).limit(0)).count() == 0
    # ids on several rows and null ids
    mixed = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)]
    kept = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(mixed, "doc_id long, text string")).collect()]
    groups = {}
    for (i, _), g in zip(mixed, (want[k] for k in range(len(texts)))):
        groups.setdefault(g, []).append(10**9 if i is None else i)
    assert sorted(10**9 if i is None else i for i, _ in kept) == sorted(min(v) for v in groups.values())


def test_simhash_tiles_lose_no_link(spark):
    random.seed(8)
    centre = random.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 9))) for _ in range(300)} | {random.getrandbits(64) for _ in range(300)}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for tile, group in ((simhash.TILE, simhash.GROUP), (7, 2048), (7, 16), (4096, 40), (50, 1)):
        edges = [(r["u"], r["v"]) for r in simhash.links(df, tile=tile, group=group).collect()]
        assert roots(signed, edges) == want
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in edges)


def test_tiles_are_skipped_at_registered_sizes():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    prints = np.unique(np.array([simhash.fingerprint(t or "") for t in texts], np.uint64))
    assert len(prints) <= simhash.GROUP  # one group, all its links by tiles
    pop = np.sort(np.bitwise_count(prints).astype(int))
    i, j = simhash.tile_pairs(pop, simhash.FINE, simhash.RADIUS)
    tiles = -(-len(pop) // simhash.FINE)
    kept = set(zip(i.tolist(), j.tolist()))
    assert len(kept) < 0.75 * tiles * (tiles + 1) / 2  # many are skipped
    for a in range(tiles):
        for b in range(a, tiles):
            x, y = pop[a * simhash.FINE : (a + 1) * simhash.FINE], pop[b * simhash.FINE : (b + 1) * simhash.FINE]
            assert ((a, b) in kept) == (y.min() - x.max() <= simhash.RADIUS)


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(random.randint(200, 400), random.randint(200, 400)) for _ in range(150)] + [(7, 7), (100, 101)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(df.limit(0)).count() == 0


def lines_by_hand(rows, ratio):
    pages, on = Counter(r[2] for r in rows), Counter()
    for _, t, s in rows:
        on.update((s, x) for x in set((t or "").split("\n")) if t is not None and x.strip(" "))
    bad = {k for k, n in on.items() if n >= 2 and n > ratio * pages[k[0]]}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad) for i, t, s in rows}


def test_line_dedup(spark):
    random.seed(3)
    lines = [f"line {i}" for i in range(40)] + ["", " ", "menu", "menu", "menu"]
    texts = [None, "", "\n", *("\n".join(random.choices(lines, k=random.randint(1, 12))) for _ in range(90))]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [(200, "alone\nalone", "one page"), (201, "both\nx", "two pages"), (202, "both\ny", "two pages"), (203, "menu\n" * 20_000 + "z", "s1")]
    texts += ["alone\nalone", "both\nx", "both\ny", rows[-1][1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("n_lines", "kept_text", "host", "line", "a", "pages", "k")})
    want = lines_by_hand(rows, 0.3)
    assert any(w != t for w, t in zip(want.values(), texts))
    for limit in (line_dedup.BROADCAST_LINES, 0):
        out = line_dedup.drop_lines(docs, ratio=0.3, limit=limit)
        assert out.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want, limit
    assert want[200] == "alone\nalone" and want[201] == "x"
    count = line_dedup.annotate(docs.drop("kept_text"), ratio=0.3).where("doc_id = 2").first()
    assert (count["n_lines"], count["n_dropped"], count["kept_text"]) == (2, 0, "\n")
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0
