"""Batches, samples and training pairs, deterministic by a seeded hash.

Draws follow the hash of a row's key, so that a sample doesn't depend on partitions or
on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import saved


def draw(seed: int, *key: str) -> Column:
    """32 hexadecimal digits for each key, which order rows at random; MD5, which other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def below(share: float) -> str:
    """The digits below which a draw falls with a chance of ``share``."""
    return f"{round(share * (1 << 32)):08x}" if share < 1 else "g"


def draw_number(seed: int, *key: str) -> Column:
    """A whole number below 2^52 for each key."""
    return F.conv(F.left(draw(seed, *key), F.lit(13)), 16, 10).cast("long")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``n`` from 0 along the order, without one task that holds all rows.

    Rows are dealt into ranges of the order; each range is numbered on its own and
    moved up by the sizes of the ranges before it, which are one row each. The ranges
    come from a sample and so are saved: both uses must see the same ones, even if an
    executor is lost between them.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    met = ranged.withColumn("_own", own).join(F.broadcast(shift), "_part")  # a row for each shuffle partition
    return met.withColumn("n", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def batches(df: DataFrame, order: list[Column], size: int, keep_remainder: bool = True) -> DataFrame:
    """``batch`` along the order; a last batch that isn't full stays only if asked for."""
    rows = numbered(df, order).withColumn("batch", F.floor(F.col("n") / size))
    if keep_remainder:
        return rows.drop("n")
    full = df.agg(F.floor(F.count("*") / size).alias("_full"))
    return rows.join(F.broadcast(full)).where(F.col("batch") < F.col("_full")).drop("n", "_full")  # one row is broadcast


def shuffled_batches(df: DataFrame, seed: int, key: list[str], size: int) -> DataFrame:
    return batches(df, [draw(seed, *key), *map(F.col, key)], size)


def clustered_batches(df: DataFrame, by: list[Column], size: int, seed: int) -> DataFrame:
    """Batches of neighbours in the order ``by``; ``place`` is each batch's turn, shuffled."""
    rows = batches(df, by, size)
    return rows.withColumn("place", draw(seed, "batch"))


def sample(df: DataFrame, seed: int, key: list[str], n: int) -> DataFrame:
    """n rows without replacement; each task sends n rows at most."""
    return df.orderBy(draw(seed, *key), *key).limit(n)


def sample_by_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by the order; Spark cuts groups to n rows before the shuffle too."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def pair_samples(items: DataFrame, group: str, item: str, gold: Column, seed: int) -> DataFrame:
    """(group, first, second, kind) for each group: its first gold pair, two gold with a distractor, one of two distractors.

    Groups need two gold items and two distractors.
    """
    marked = items.select(group, F.col(item).alias("item"), gold.alias("gold"), draw(seed, group, item).alias("draw"))
    order = F.when(F.col("gold"), F.lit("")).otherwise(F.col("draw"))
    place = F.row_number().over(W.partitionBy(group, "gold").orderBy(order, "item"))
    first = marked.withColumn("place", place).where("place <= 2")
    named = F.concat(F.when(F.col("gold"), "g").otherwise("d"), F.col("place").cast("string"))
    wide = first.withColumn("name", named).groupBy(group).pivot("name", ["g1", "g2", "d1", "d2"]).agg(F.first("item"))
    whole = wide.na.drop()
    pairs = F.array(*[F.struct(F.col(a).alias("first"), F.col(b).alias("second"), F.lit(k).alias("kind")) for a, b, k in (
        ("g1", "g2", "gold"), ("g1", "d1", "mixed"), ("g2", "d2", "mixed"), ("d1", "d2", "false"))])
    return whole.select(group, F.explode(pairs).alias("p")).select(group, "p.*")


def choose(seed: int, key: list[str], shares: list[tuple[str, float]]) -> Column:
    """A name for each key, drawn by cumulative shares."""
    u, upto = draw(seed, *key), 0.0
    out = F.lit(None).cast("string")
    bounds = []
    for name, share in shares:
        upto += share
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        out = F.when(u < below(bound), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(shares[-1][0]))
