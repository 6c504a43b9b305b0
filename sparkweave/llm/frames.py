"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..storage import delete, own_folder
from ..workers import reach_workers

#: Rows and bytes of an Arrow batch between the JVM and a Python worker. Texts can
#: be long, so the library's default of 10,000 rows would not bound memory.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to what long texts allow."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str
) -> DataFrame:
    """``make()`` runs once in each task; what it returns maps a batch to columns.

    An empty partition gives no batch and so no row.
    """
    bounded_batches(df.sparkSession)
    reach_workers(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, kind)


def map_stream(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """``work`` runs once in each task, over all of its batches that have rows, and yields columns."""
    bounded_batches(df.sparkSession)
    reach_workers(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for columns in work(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column that a lambda names may be copied into the lambda by the optimizer
    and so be computed for each element; a lambda's own argument never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Scratch:
    """What is saved within it is deleted when it ends, but for what is kept.

    A frame that leaves it must itself be kept: a plan that still reads another frame
    saved within would find no files.
    """

    open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` saved so that it outlasts this scratch."""
        out = saved(df)
        self.paths.pop()
        return out

    def __exit__(self, *error: object) -> None:
        Scratch.open.remove(self)
        for path in self.paths:
            delete(self.spark, path)


def saved(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, outlives executors.

    What no scratch deletes stays until ``storage.clean``.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a frame that ``saved`` returned."""
    spark = df.sparkSession
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sparkweave-" not in root:
            raise ValueError(f"not a saved frame: {root}")
        delete(spark, root)
