"""Training data: filters, preprocessing, splits, and candidates as samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import sampling

Keep = Callable[[DataFrame], Column]
Preprocess = Callable[[DataFrame], Column]


def prepared(samples: DataFrame, keep: Keep | None = None, preprocess: Preprocess | None = None, column: str = "sample") -> DataFrame:
    """Samples that the filter keeps, with ``column`` replaced by what ``preprocess`` makes; null drops the row."""
    if keep is not None:
        samples = samples.where(F.coalesce(keep(samples), F.lit(False)))
    if preprocess is not None:
        samples = samples.withColumn(column, preprocess(samples)).where(F.col(column).isNotNull())
    return samples


@dataclass(frozen=True)
class TrainingData:
    """A train and a dev set behind the same filter and preprocessing, each cut to a seeded sample if asked for."""

    train: DataFrame
    dev: DataFrame
    key: list[str]
    column: str = "sample"
    keep: Keep | None = None
    preprocess: Preprocess | None = None
    sample_train: int | None = None
    sample_dev: int | None = None
    seed: int = 18

    def _part(self, rows: DataFrame, n: int | None) -> DataFrame:
        rows = prepared(rows, self.keep, self.preprocess, self.column)
        return rows if n is None else sampling.sample(rows, self.seed, self.key, n)

    def get_train(self) -> DataFrame:
        return self._part(self.train, self.sample_train)

    def get_dev(self) -> DataFrame:
        return self._part(self.dev, self.sample_dev)


def candidate_samples(candidates: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """A question's candidates as its samples: ``place`` from 0 in their order, ``batch`` by ``size``.

    A question's candidates are few by nature; batches don't mix questions.
    """
    place = (F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1).cast("long")
    return candidates.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size))
