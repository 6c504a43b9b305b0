"""Corpora in splits, stored indexes, and the numbering of stored encodings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from .stores import DuplicateKeys, check_unique

SPLITS = ("train", "dev")


class SplitCorpus:
    """Questions or documents in a train and a dev part, one folder each; a title is in one of them, once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, key: str = "title", **splits: DataFrame) -> None:
        """``train`` and ``dev``, or one of them; a title that comes twice is refused."""
        if not splits or set(splits) - set(SPLITS):
            raise ValueError(f"splits are {', '.join(SPLITS)}")
        rows = None
        for name, df in splits.items():
            part = df.withColumn("split", F.lit(name))
            rows = part if rows is None else rows.unionByName(part)
        check_unique(rows, key)
        rows.write.mode("errorifexists").partitionBy("split").parquet(self.path)

    def split(self, name: str) -> DataFrame:
        """One part; of the other no file is read."""
        if name not in SPLITS:
            raise ValueError(f"splits are {', '.join(SPLITS)}")
        return self.spark.read.parquet(self.path).where(F.col("split") == name).drop("split")


class IndexStore:
    """Postings with what is needed to read them: the settings they were made by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, index: DataFrame, **metadata: object) -> None:
        """``index``: postings (key, term, tf), written in ranges of the term, so that a search for terms skips most files."""
        index.repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{self.path}/postings")
        self.spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{self.path}/metadata")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def metadata(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/metadata").first().value)


def encoding_index(encodings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, first_id, last_id): where each paragraph's vectors stand in one matrix of all, in the order of key and ``order``."""
    numbered = sampling.numbered(encodings.select(*key, *order), [F.col(c) for c in (*key, *order)])
    return numbered.groupBy(*key).agg(F.min("n").alias("first_id"), F.max("n").alias("last_id"))


def prefixed(scalars: DataFrame, prefix: str) -> DataFrame:
    """An evaluation (name, value) with ``prefix`` before each name."""
    return scalars.withColumn("name", F.concat(F.lit(prefix), "name"))


def merged(*scalars: DataFrame) -> DataFrame:
    """Evaluations (name, value) as one; a name that comes twice is refused."""
    rows = scalars[0]
    for more in scalars[1:]:
        rows = rows.unionByName(more)
    twice = rows.groupBy("name").count().where("count > 1").orderBy("name").limit(1).collect()
    if twice:
        raise DuplicateKeys(f"two evaluations have the name {twice[0].name!r}")
    return rows
