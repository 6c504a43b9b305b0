"""Text functions that no built-in expresses, on Arrow batches."""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .text import TOKEN

# Types are objects, since a type's name can be read only once there is a session.
SPANS = ArrayType(
    StructType(
        [StructField("text", StringType()), StructField("space", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]
    )
)

_TOKEN = regex.compile(TOKEN)


@F.pandas_udf(StringType())
def nfd(texts: pd.Series) -> pd.Series:
    """Unicode canonical decomposition."""
    return texts.str.normalize("NFD")


@F.pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Lower case without combining marks, after compatibility decomposition."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return texts.map(plain, na_action="ignore")


#: Characters whose tokens are Python objects at a time.
SLICE = 1 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) of about ``SLICE`` characters, or of one longer text."""
    first = held = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if held + n > SLICE and i > first:
            yield first, i - first
            first, held = i, 0
        held += n
    if len(texts) > first:
        yield first, len(texts) - first


def _spans(texts: pa.Array) -> pa.Array:
    """Arrays of tokens, made of flat columns."""
    words, spaces, starts, ends, offsets = [], [], [], [], [0]
    for text in texts.to_pylist():
        text = text or ""
        spans = [m.span() for m in _TOKEN.finditer(text)]
        words += [text[a:b] for a, b in spans]
        # The last token takes no space after it.
        spaces += [text[a:n] for (a, _), (n, _) in zip(spans, spans[1:])] + [text[a:b] for a, b in spans[-1:]]
        starts += [a for a, _ in spans]
        ends += [b for _, b in spans]
        offsets.append(len(words))
    columns = [pa.array(words, pa.string()), pa.array(spaces, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["text", "space", "start", "end"]))


@F.arrow_udf(SPANS)
def token_spans(texts: pa.Array) -> pa.Array:
    """Tokens with the text up to the next token, and their offsets, ends exclusive."""
    return pa.concat_arrays([_spans(texts.slice(a, n)) for a, n in _slices(texts)] or [_spans(texts)])


def with_token_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    """``text`` replaced by its ``token_spans`` as ``name``, in batches that are small however long the texts are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in _slices(batch[text]):
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keys), _spans(part[text])], [*keys, name])

    keys = [c for c in df.columns if c != text]
    return df.mapInArrow(each, StructType([*(df.schema[c] for c in keys), StructField(name, SPANS)]))


def murmur3_32(raw: bytes, seed: int = 0) -> int:
    """The public 32-bit MurmurHash3, unsigned. Spark's own differs in the last bytes and the seed."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(raw) // 4 * 4
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    stir = lambda k: rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    for (k,) in struct.iter_unpack("<I", raw[:whole]):
        h = (rotate(h ^ stir(k), 13) * 5 + 0xE6546B64) & mask
    if tail := raw[whole:]:
        h ^= stir(int.from_bytes(tail, "little"))
    h ^= len(raw)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def hash_bucket(buckets: int = 1 << 24):
    """A function from terms to their bucket."""

    @F.pandas_udf(LongType())
    def bucket(terms: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(terms, use_na_sentinel=True)
        of = pd.Series([murmur3_32(t.encode()) % buckets for t in distinct], dtype="Int64")
        return pd.Series([None if c < 0 else of[c] for c in codes], dtype="Int64")

    return bucket
