"""Operator 2: token counts by the whole-token shortcut.

Each string of the vocabulary is merged alone once, on the driver, before any text is
read. Those that come out as the one token they are, are proven: a pre-token equal to
one counts 1 without merging. Only the other pre-tokens are merged, each distinct one
about once in a worker. The proven strings, at most the vocabulary, go to the workers.

Cases: a null text counts as empty, 0 bytes and 0 tokens; an empty table gives an
empty table; the tokenizer's added strings inside a text count as one token each, as
the library does by default; a very long text is counted whole, in memory that is a few
times its size; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .byte_pair_codec import MEMO_CHARS, MEMO_ENTRIES, as_bytes, as_letters
from .frames import map_batches, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_only(spec: str) -> Tokenizer:
    """The tokenizer of ``spec`` without splitting and added tokens: only its merges."""
    parts = json.loads(spec)
    if parts["model"]["type"] != "BPE" or parts["normalizer"] or parts["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
    if parts["pre_tokenizer"]["add_prefix_space"] or not parts["pre_tokenizer"]["use_regex"]:
        raise ValueError("the tokenizer must split by its pattern and add no space")
    parts |= {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": [], "truncation": None, "padding": None}
    return Tokenizer.from_str(json.dumps(parts))


def prove_whole(merger: Tokenizer) -> set[str]:
    """The vocabulary strings, as text, that encode alone as one token."""
    proven = set()
    for name, number in merger.get_vocab(with_added_tokens=False).items():
        if [t.id for t in merger.model.tokenize(name)] == [number]:
            try:
                proven.add(as_bytes(name).decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token of valid text
    return proven


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(4)
def proven_at(path: str) -> frozenset[str]:
    """The proven strings of the tokenizer file at ``path``."""
    return frozenset(prove_whole(merge_only(read_spec(path))))


#: A worker's counters, for all of its tasks.
COUNTERS: dict[tuple[str, str], Counter] = {}


class Counter:
    """Token counts of texts. ``whole``: the proven strings."""

    def __init__(self, path: str, pattern: str, whole: frozenset[str] | None = None):
        spec = read_spec(path)
        self.merger = merge_only(spec)
        self.whole = dict.fromkeys(proven_at(path) if whole is None else whole, 1)
        self.split = regex.compile(pattern).findall
        added = [t for t in json.loads(spec)["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring text aren't supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.memo = dict(self.whole)

    def _learn(self, words: list[str]) -> dict[str, int]:
        merge = self.merger.model.tokenize
        found = {w: len(merge(as_letters(w.encode()))) for w in words}
        if len(self.memo) > len(self.whole) + MEMO_ENTRIES:
            self.memo = dict(self.whole)
        self.memo |= {w: n for w, n in found.items() if len(w) <= MEMO_CHARS}
        return found

    def _plain(self, text: str) -> int:
        words = self.split(text)
        counts = list(map(self.memo.get, words))
        if None in counts:
            new = self._learn(list({w for w, n in zip(words, counts) if n is None}))
            return sum(new[w] if n is None else n for w, n in zip(words, counts))
        return sum(counts)

    def count(self, text: str) -> int:
        if self.added is None or not (found := self.added.findall(text)):
            return self._plain(text)
        return len(found) + sum(map(self._plain, self.added.split(text)))


def counter_at(path: str, pattern: str, whole: frozenset[str]) -> Counter:
    if (path, pattern) not in COUNTERS:
        COUNTERS[path, pattern] = Counter(path, pattern, whole)
    return COUNTERS[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether these pass ``limit``."""

    whole = docs.sparkSession.sparkContext.broadcast(proven_at(path))

    def make():
        counter = counter_at(path, pattern, whole.value)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            texts = texts_of(batch)
            counts = [counter.count(t) for t in texts]
            return {
                "doc_id": batch.column("doc_id"),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
