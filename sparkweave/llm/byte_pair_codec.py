"""Operator 1: byte-level BPE encoding and decoding.

A SentencePiece BPE model is serialised straight from the vocabulary: every token
becomes a piece whose bytes are written as printable characters, scored by the
negative of its rank, under identity normalisation. That library's merge loop (best
score first, then leftmost) is then the rank-order merge loop of the vocabulary.
Pre-tokens are encoded with it and decoded by the inverse of the byte mapping.

Cases: a null text counts as empty and gives no ids; equal rows give equal rows; an
empty table gives an empty table; other columns are ignored. A pre-token of any
length costs n log n, since the merge loop uses a heap.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .frames import map_batches, texts_of

#: Pre-tokens remembered by a task: so many at most, none longer than this.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> str:
    """A printable character for each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


LETTERS = byte_letters()
TO_LETTERS = {b: LETTERS[b] for b in range(256)}
FROM_LETTERS = {ord(c): chr(b) for b, c in enumerate(LETTERS)}


def as_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_LETTERS)


def as_bytes(letters: str) -> bytes:
    return letters.translate(FROM_LETTERS).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _flag(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The wire form of a SentencePiece model whose piece ids are the ranks."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for bytes {missing[:5]}")
    pieces = [
        _message(1, _message(1, as_letters(t).encode()) + b"\x15" + struct.pack("<f", -r) + _flag(3, 1))
        for t, r in by_rank
    ]
    pieces.append(_message(1, _message(1, "".encode()) + b"\x15" + struct.pack("<f", 0) + _flag(3, 2)))
    unknown = len(by_rank)
    no_id = (1 << 64) - 1  # -1 as a varint
    trainer = _flag(3, 2) + _flag(4, unknown + 1) + _flag(40, unknown) + b"".join(_flag(f, no_id) for f in (41, 42, 43))
    normalizer = _message(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normalizer)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.whole = {t: struct.pack("<I", r) for t, r in ranks.items()}
        self.pieces = [as_bytes(self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens; a token of the vocabulary is never merged."""
        found, rest = {}, []
        for word in words:
            ids = self.whole.get(word.encode())
            if ids is None:
                rest.append(word)
            else:
                found[word] = ids
        for word, ids in zip(rest, self.model.encode([as_letters(w.encode()) for w in rest], num_threads=1) if rest else ()):
            found[word] = np.array(ids, "<u4").tobytes()
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        self.memo |= {w: ids for w, ids in found.items() if len(w) <= MEMO_CHARS}
        return found

    def encode(self, text: str) -> bytes:
        words = self.split(text)
        ids = list(map(self.memo.get, words))
        if None in ids:
            new = self._learn(list({w for w, i in zip(words, ids) if i is None}))
            ids = [new[w] if i is None else i for w, i in zip(words, ids)]
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec_at(rank_path: str, pattern: str) -> Codec:
    """A worker's codec; its tables are made once, for all of its tasks."""
    return Codec(read_ranks(rank_path), pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    The rank file is part of the installed library and so at the same path on every worker.
    """

    def make():
        codec = codec_at(rank_path, pattern)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            ids = [codec.encode(t) for t in texts_of(batch)]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids],
            }
            if with_ids:
                out["ids"] = [np.frombuffer(i, "<u4").astype("<i4") for i in ids]
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA + (", ids array<int>" if with_ids else ""))
