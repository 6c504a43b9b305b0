"""What a user plugs in: tokenizers, encoders and readers; with defaults that need no trained weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .functions import text as T


class Tokenizer(Protocol):
    def tokens(self, text: Column) -> Column:
        """An array of tokens."""


class SimpleTokenizer:
    """Runs of letters, digits and marks, or single other characters."""

    def tokens(self, text: Column) -> Column:
        return T.tokens(text)


class OffsetTokenizer:
    """Tokens at offsets that come with the text."""

    def __init__(self, offsets: Column):
        self.offsets = offsets

    def tokens(self, text: Column) -> Column:
        return T.by_offsets(text, self.offsets)


class PythonTokenizer:
    """A tokenizer that is a Python function, as those of language toolkits are, run on Arrow batches.

    ``make`` is called once in each worker, so that a model is loaded once there; what it
    returns maps a text to its tokens. A null text has no tokens.
    """

    def __init__(self, make: Callable[[], Callable[[str], list[str]]]):
        self.make = make

    def tokens(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf(ArrayType(StringType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            split = make()
            for texts in batches:
                yield texts.fillna("").map(lambda t: list(split(t)) if t else [])

        return run(text)


TOKENIZERS: dict[str, Callable[..., Tokenizer]] = {"simple": SimpleTokenizer, "offsets": OffsetTokenizer}


def register_tokenizer(name: str, make: Callable[..., Tokenizer]) -> None:
    """Let ``tokenizer(name)`` give a user's tokenizer; a name that is taken is refused."""
    if name in TOKENIZERS:
        raise ValueError(f"there is a tokenizer named {name}")
    TOKENIZERS[name] = make


def tokenizer(name: str, *args) -> Tokenizer:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {name}; known: {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name](*args)


class Encoder(Protocol):
    size: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """(texts, size) vectors."""


class HashedEncoder:
    """Signed feature hashing of words, scaled to length 1: deterministic, without training."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        # Each distinct word is hashed once.
        code, words = pd.factorize(np.array([w for own in split for w in own], object))
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        out = np.zeros(len(texts) * self.size)
        if len(code):
            np.add.at(out, owner * self.size + hashes[code] % self.size, np.where(hashes[code] >> 16 & 1, 1.0, -1.0))
        out = out.reshape(len(texts), self.size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, encoder: Encoder, key: list[str], text: str) -> DataFrame:
    """(key, vector) of each row; one encoder in each task."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[key].copy()
            out["vector"] = list(encoder.encode(batch[text].fillna("").tolist()))
            yield out

    return df.select(*key, text).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", vector array<double>")


class Reader(Protocol):
    def read(self, question: str, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end scores of each token."""
