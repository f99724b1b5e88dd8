"""The registered queries on the smallest tables, against brute force where there is no SQL."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash

from tidewire.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def test_each_operator_has_one_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_pieces(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, FOLDER).collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_repeated_passages(spark, docs):
    from .brute import removed_by_hand

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_suffix_dedup(spark, FOLDER).collect()}
    assert got == dict(zip(docs, removed_by_hand([r["text"] for r in docs.values()])))


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op5_simhash(spark, FOLDER).collect()}
    prints = {}
    for i, r in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        prints[i] = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert {i: p for i, (p, _) in got.items()} == prints
    label = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {i: c for i, (_, c) in got.items()} == label


def test_licences(spark, docs):
    from .test_narrow import licences_by_hand

    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r in queries.op6_license_scan(spark, FOLDER).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]]["text"] or ""))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert (r["labels"], r["score"]) == licences_by_hand(docs[r["doc_id"]]["text"] or "")


def test_held_out_accuracy(spark, docs):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and len(held) > 200
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_personal_data(spark, docs):
    from .test_pii import by_hand, graph_by_hand
    from tidewire.llm import pii

    spans = dict(zip(docs, graph_by_hand([r["text"] for r in docs.values()])))
    for r in queries.op2_pii(spark, FOLDER).collect():
        assert r["spans"] == spans[r["doc_id"]]
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in by_hand(docs[r["doc_id"]]["text"]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_languages(spark, docs):
    from .test_narrow import ppm_by_hand
    from tidewire.llm import language_id

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    known = [(language_id.letters_of(r["text"]), r["lang"]) for i, r in docs.items() if not held[i] and r["lang"] and r["text"]]
    labels = sorted({k for _, k in known})
    assert max(sum(k == x for _, x in known) for k in labels) <= language_id.SAMPLE_DOCS  # so all of them are learned from
    hand = [ppm_by_hand([t for t, x in known if x == k]) for k in labels]
    seen = 0
    for r in queries.op7_language_id(spark, FOLDER).collect():
        line = language_id.letters_of(docs[r["doc_id"]]["text"] or "")
        assert r["held_out"] == held[r["doc_id"]] and (r["lang_pred"] == "und") == (not line)
        if line and len(line) < 1500:
            bits = [h(line) for h in hand]
            best = min(bits)
            assert r["lang_pred"] == labels[bits.index(best)] and abs(r["score"] - 1 / sum(2.0 ** max(best - b, -1000) for b in bits)) < 1e-2
            seen += 1
    assert seen > 30
