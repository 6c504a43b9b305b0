"""Operator 8: quality classifier by compression.

Two zstandard dictionaries are built, from well and badly rated texts. A text is cut
into windows of WINDOW bytes, which are compressed each by itself under either
dictionary and under none, so that a text's own repetitions don't hide what it shares
with the dictionaries. The difference of the two sizes, divided by the size without a
dictionary, is the one feature; a logistic curve over it, fitted on other labelled
texts and weighted to the labels' true shares, makes it a calibrated probability.

Dictionaries and curve are fitted on a bounded sample of the labelled rows: at most
SAMPLE_DOCS of each label, half for either; a dictionary takes at most TEXT_CHARS of
the start of each text and DICTIONARY_BYTES in all. Every text is scored, whole, in
memory that doesn't grow with it beyond the text itself.

Cases: a null or empty text has no bytes to compare and gets the share of good texts;
unlabelled rows are scored like others; equal texts get equal scores; an empty table
gives an empty table; other columns, whatever their names, are ignored. A document
labelled twice is taken with its lowest label, one with two texts with the lesser.
Without training rows of both labels there is nothing to compare, and every text gets
the share of good ones among the training rows, 0.5 if there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, texts_of

#: Bounds of the sample: documents of each label, half for the dictionaries and half
#: for the curve; characters of a text and bytes of all in a dictionary.
SAMPLE_DOCS, TEXT_CHARS, DICTIONARY_BYTES = 2000, 2000, 1 << 20
WINDOW, LEVEL, THRESHOLD = 128, 3, 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_good long, n_bad long, n_plain long"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """Two dictionaries, intercept and slope of the curve, and the share of good texts.

    Without dictionaries all texts get that share.
    """

    good: bytes
    bad: bytes
    intercept: float
    slope: float
    prior: float


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> tuple[DataFrame, float | None]:
    """(text, label, half) of at most ``size`` labelled documents of each label, and the share of label 1 among all training rows.

    Rows are picked by a hash of their id, in the labels alone, so that only the picked
    texts are joined.
    """
    train = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    train = train.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    share = train.agg(F.avg("label").alias("share")).first()["share"]
    by_hash = lambda v: train.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    picked = by_hash(0).unionByName(by_hash(1)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * size ids: a bound that doesn't grow with the data.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "half").agg(F.min("text").alias("text"))
    return rows, share


def build_dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A raw dictionary of the texts, the first ones nearest to what is compressed."""
    return b"\n".join(t.encode() for t in reversed(texts))[-size:]


class Sizes:
    """Compressed sizes of a text's windows under the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.plain = (
            zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            for d in (
                zstandard.ZstdCompressionDict(good, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                zstandard.ZstdCompressionDict(bad, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                None,
            )
        )

    def __call__(self, text: str) -> tuple[int, int, int]:
        raw = text.encode()
        windows = [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]
        good, bad, plain = (sum(len(c.compress(w)) for w in windows) for c in (self.good, self.bad, self.plain))
        return good, bad, plain


def difference(good: np.ndarray, bad: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The normalised size difference: above 0 for a text that is more like good ones; 0 for an empty text."""
    return (bad - good) / np.maximum(plain, 1)


def fit_curve(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 60) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton steps, rows weighted so that the labels have their true shares."""
    centre, spread = x.mean(), x.std() + 1e-9
    design = np.stack([np.ones(len(x)), (x - centre) / spread], axis=1)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 1e-2 * w
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * centre / spread), float(w[1] / spread)


def _sizes(rows: DataFrame, good: bytes, bad: bytes, columns: list[str]) -> DataFrame:
    """``columns`` of the rows with n_bytes, n_good, n_bad and n_plain of their texts."""
    both = rows.sparkSession.sparkContext.broadcast((good, bad))  # bounded by DICTIONARY_BYTES each
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def make():
        measure = Sizes(*both.value)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            texts = texts_of(batch)
            sizes = [measure(t) for t in texts]
            own = {c: batch.column(c) for c in columns}
            return own | {"n_bytes": [len(t.encode()) for t in texts]} | {n: [s[i] for s in sizes] for i, n in enumerate(("n_good", "n_bad", "n_plain"))}

        return work

    return map_batches(rows.select(*columns, "text"), make, f"{kinds}, n_bytes long, n_good long, n_bad long, n_plain long")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Model:
    rows, share = sample(docs, labels, size)
    # At most 2 * size texts of at most TEXT_CHARS characters come to the driver.
    cut = rows.select("doc_id", "label", "half", F.substring("text", 1, TEXT_CHARS).alias("text")).collect()
    halves = [{r.label for r in cut if r.half == h} for h in (0, 1)]
    if len(halves[0] | halves[1]) < 2:
        return Model(b"", b"", 0.0, 0.0, 0.5 if share is None else float(share))
    apart = all(len(h) == 2 for h in halves)  # few rows: both are fitted on all
    chosen = sorted((r for r in cut if not apart or r.half == 0), key=lambda r: r.doc_id)
    good, bad = (build_dictionary([r.text for r in chosen if r.label == v]) for v in (1, 0))
    curve = _sizes(rows.where("half = 1") if apart else rows, good, bad, ["doc_id", "label"]).where("n_bytes > 0").orderBy("doc_id").toPandas()
    if curve["label"].nunique() < 2:
        return Model(b"", b"", 0.0, 0.0, float(share))
    x = difference(*(curve[n].to_numpy(float) for n in ("n_good", "n_bad", "n_plain")))
    return Model(good, bad, *fit_curve(x, curve["label"].to_numpy(float), share), float(share))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A score for each document and what it predicts, with the sizes that it comes from."""
    named = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    sized = _sizes(named, model.good, model.bad, ["doc_id", "held_out"])
    difference = (F.col("n_bad") - F.col("n_good")) / F.greatest(F.col("n_plain"), F.lit(1))
    curve = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * difference)))
    told = bool(model.good and model.bad)
    score = F.round(F.when((F.col("n_bytes") > 0) & F.lit(told), curve).otherwise(F.lit(model.prior)), 6)
    scored = sized.withColumn("score", score)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_good", "n_bad", "n_plain")
