"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words (a run of word marks and what follows it) never merge with each other, so each
distinct word is encoded once. All new words of a chunk lie in one flat numpy array of
symbols; a round finds the smallest pair rank of every word, merges its occurrences from
the left in all words at once and compacts the array, until no pair is left.

Defined results: a null or empty text has only the begin and end ids and decodes to the
empty text; rows, repeated ones included, are independent of each other; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import append, others

MARK = "▁"
#: Texts that tell whether a model normalises, drops spaces or has no byte pieces.
PROBES = ["a", "a  b ", " lead", "x\ty\nz", "\ufb01 \uff21 e\u0301 \u00bd", "\U0001f9ff\u0378"]
#: Bytes of words and ids that a worker keeps; beyond it the memory starts anew. A word costs OVERHEAD besides.
BYTES_KEPT, OVERHEAD = 24_000_000, 120
#: Bytes of text that are encoded at once; a step takes some 100 bytes for each byte of words that it has not met yet.
STEP_BYTES = 400_000
NO_PAIR = np.int64(1) << 40
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PieceModel:
    """Pieces, pair ranks and byte pieces of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.byte_id = np.full(256, self.unk, np.int64)
        self.surface: list[bytes] = [p.replace(MARK, " ").encode() for p in pieces]
        for i in range(n):
            if model.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
            elif model.is_control(i):
                self.surface[i] = b""
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        # Characters that only occur inside longer pieces get symbols of their own.
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.n_pieces = n
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)  # an unknown character is its negative code point
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = sorted({-model.get_score(i) for i in ids.values()})
        rank_of = {s: r for r, s in enumerate(order)}
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = (rank_of[-model.get_score(i)], i)
        # An open-addressed table that numpy can probe for many keys at once.
        self.shift = 64 - max(10, (8 * len(pairs)).bit_length())
        self.pair_key = np.full((1 << (64 - self.shift)) + 64, -1, np.int64)
        self.pair_rank, self.pair_into = np.full_like(self.pair_key, NO_PAIR), np.zeros_like(self.pair_key)
        for k, (rank, into) in pairs.items():
            at = (k * int(SPREAD) % (1 << 64)) >> self.shift
            while self.pair_key[at] >= 0:
                at += 1
            self.pair_key[at], self.pair_rank[at], self.pair_into[at] = k, rank, into
        loose = "" if any("\n" in p for p in ids) else "\n"  # a character in no piece stands alone
        self.word = re.compile(f"{MARK}+[^{MARK}{loose}]*|[^{MARK}{loose}]+" + ("|\n" if loose else ""))
        for text in PROBES:
            if np.frombuffer(b"".join(self.encode_words(self.words(text))), "<u4").tolist() != model.encode(text):
                raise ValueError(f"{path}: only BPE models that leave texts as they are, mark words in front and fall back to bytes are known")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_PAIR: none) and its place in the pair table."""
        key = np.where((left | right) >= 0, (left << 20) | right, -2)
        at = ((key.view(np.uint64) * SPREAD) >> np.uint64(self.shift)).view(np.int64)
        found = self.pair_key[at]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] += 1
            found = self.pair_key[at[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_PAIR), at

    def words(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        rank, at = np.full(len(sym), NO_PAIR), np.zeros(len(sym), np.int64)
        fresh = np.arange(len(sym) - 1)  # places whose pair isn't looked up yet
        while True:
            found, where = self.ranks(sym[fresh], sym[fresh + 1])
            rank[fresh], at[fresh] = np.where(word[fresh] == word[fresh + 1], found, NO_PAIR), where
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, start)  # the smallest rank of each word
            length = np.diff(np.r_[start, len(sym)])
            live = np.repeat(best < NO_PAIR, length)
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            if not live.any():
                break
            hit = (rank == np.repeat(best, length)) & live
            hit = self._leftmost(hit)
            hit = self._safe(sym, word, rank, at, hit)
            sym = np.where(hit, self.pair_into[at], sym)
            keep = live & ~np.r_[False, hit[:-1]]
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            # a merge makes new pairs with the symbols on both sides; the last symbol has none on its right
            made = np.flatnonzero(hit[keep])
            rank[made] = NO_PAIR
            fresh = np.unique(np.r_[made, made - 1])
            fresh = fresh[(fresh >= 0) & (fresh < len(sym) - 1)]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        return self._to_ids(sym, word, len(words))

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of chains of overlapping hits, every other one, from the left."""
        at = np.flatnonzero(hit)
        if not len(at):
            return hit
        first = np.r_[True, np.diff(at) != 1]
        run_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        out = np.zeros_like(hit)
        out[at[(np.arange(len(at)) - run_start) % 2 == 0]] = True
        return out

    def _safe(self, sym, word, rank, at, hit) -> np.ndarray:
        """Keep only the first merge of words where a merge makes a pair that ranks no lower.

        In the others the order of the merges of a round can't matter.
        """
        i = np.flatnonzero(hit)
        new = self.pair_into[at[i]]
        bad = np.zeros(len(i), bool)
        right = np.minimum(i + 2, len(sym) - 1)
        ok = (i + 2 < len(sym)) & (word[right] == word[i])
        bad |= ok & (self.ranks(new, sym[right])[0] <= rank[i])
        left = np.maximum(i - 1, 0)
        ok = (i > 0) & (word[left] == word[i])
        # the neighbour on the left may itself be the second half of a merge
        merged_left = np.r_[False, np.diff(i) == 2]
        left_sym = np.where(merged_left, np.r_[new[:1], new[:-1]], sym[left])
        bad |= ok & (self.ranks(left_sym, new)[0] <= rank[i])
        if bad.any():
            risky = np.isin(word[i], word[i[bad]])
            first = np.r_[True, word[i][1:] != word[i][:-1]]
            hit = hit.copy()
            hit[i[risky & ~first]] = False
        return hit

    def _to_ids(self, sym: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        lost = (sym < 0) | (sym >= self.n_pieces)
        if lost.any():  # spelled out in byte pieces
            names = {int(self.of_char[c]): c for c in range(0x110000) if self.of_char[c] >= self.n_pieces} if (sym >= self.n_pieces).any() else {}
            spelled = [chr(names[s] if s >= 0 else -1 - s).encode("utf-8", "replace") for s in sym[lost].tolist()]
            count = np.ones(len(sym), np.int64)
            count[lost] = [len(b) for b in spelled]
            is_byte = np.repeat(lost, count)
            sym, word = np.repeat(sym, count), np.repeat(word, count)
            sym[is_byte] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        data = sym.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=n)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian unsigned 32-bit integers)."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """One model a worker, read on first use."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encoder(path: str):
    """From texts to their ids as bytes, with a bounded memory of words already encoded."""
    model = model_at(path)
    bos, eos = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))
    known: dict[str, bytes] = {}
    held = 0

    def run(texts: list[str]) -> list[bytes]:
        nonlocal held
        split = [model.words(t) for t in texts]
        words = set().union(*split)
        if held > BYTES_KEPT:
            known.clear()
            held = 0
        new = list(words - known.keys())
        made = model.encode_words(new)
        known.update(zip(new, made))
        held += sum(map(len, new)) + sum(map(len, made)) + OVERHEAD * len(new)
        return [bos + b"".join(map(known.__getitem__, x)) + eos for x in split]

    return model, run


def _id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(b) // 4 for b in ids])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column ids (array of int, begin and end ids included)."""

    def start():
        _, run = _encoder(model_path)
        return lambda texts: [_id_lists(run(texts))]

    return append(docs, text_col, f"{ids_col} array<int>", start, STEP_BYTES)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; a null array decodes to the empty text."""
    encoded = encoded.select(*others(encoded, [text_col], ids_col))
    schema = StructType([*encoded.schema.fields, StructField(text_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            texts = [model.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs encoded and decoded in one pass: n_tokens, ids_sha256, decoded_sha256, and ids if with_ids.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256
    over the decoded text in UTF-8.
    """

    def start():
        model, run = _encoder(model_path)

        def made(texts: list[str]) -> list:
            ids = run(texts)
            out = [
                [len(b) // 4 for b in ids],
                [hashlib.sha256(b).hexdigest() for b in ids],
                [hashlib.sha256(model.decode(b).encode()).hexdigest() for b in ids],
            ]
            return [*out, _id_lists(ids)] if with_ids else out

        return made

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return append(docs, text_col, fields, start, STEP_BYTES)
