"""Vector search by exact inner product over restricted candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions import arrow_vectors as A
from ..functions import vectors as V

DIGITS = 6
#: Rows of questions and of sentences that meet in one call; a title with more is dealt out to several. Each row travels
#: once for every block of the other side, so blocks are as large as a worker's memory easily holds.
ASKED, HELD = 16384, 32768


def inner_products(candidates: DataFrame, query: str = "q", vector: str = "v") -> DataFrame:
    return candidates.withColumn("score", F.round(V.dot(F.col(query), F.col(vector)), DIGITS))


def top_k(scored: DataFrame, by: list[str], k: int, tie: list[str]) -> DataFrame:
    """The k best of each group; with ``by`` empty, of all, by a sort that keeps k rows in each task."""
    order = [F.desc("score"), *map(F.asc, tie)]
    if not by:
        return scored.orderBy(*order).limit(k)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def best_paragraphs(scored: DataFrame, by: list[str], paragraph: list[str], tie: list[str], k: int, spare: int) -> DataFrame:
    """The k best paragraphs of each group, from its k * spare best sentences.

    A paragraph takes the rank of its first sentence among these.
    """
    cut = top_k(scored, by, k * spare, tie)
    first = cut.groupBy(*by, *paragraph).agg(F.min("rank").alias("first_rank"), F.max("score").alias("score"))
    order = W.partitionBy(*by).orderBy("first_rank")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _cells(asked: DataFrame, sentences: DataFrame, sizing: DataFrame, rows: int):
    """Both sides grouped by title and block, so that each pair of a title meets in just one call.

    Questions are dealt out by qid, so those of one meet a block of sentences together.
    ``sizing``: title, a row for ``rows`` of ``asked``; it sets the number of blocks only.
    Titles with more than a block are few, one for so many rows as a block has, and are broadcast;
    a join with the sizes of all titles would send the vectors by title first.
    """
    blocks = lambda n, most: F.ceil(n / most).cast("int")
    left = sizing.groupBy("title").agg(blocks(F.count("*") * rows, ASKED).alias("_nq"))
    right = sentences.groupBy("title").agg(blocks(F.count("*"), HELD).alias("_ns"))
    large = F.broadcast(left.join(right, "title").where("_nq > 1 or _ns > 1"))
    sized = lambda side: side.where("title is not null").join(large, "title", "left")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    q = sized(asked).withColumn("_sb", every("_ns")).withColumn("_qb", own("qid", "_nq")).drop("_nq", "_ns")
    s = sized(sentences).withColumn("_qb", every("_nq")).withColumn("_sb", own("sid", "_ns")).drop("_nq", "_ns")
    keys = ["title", "_qb", "_sb"]
    return q.groupBy(*keys).cogroup(s.groupBy(*keys))


def search(
    asked: DataFrame, sentences: DataFrame, sizing: DataFrame, k: int, tie: list[str], rows: int = 1, firsts: tuple[str, int] | None = None,
) -> DataFrame:
    """Scored pairs of a title, without vectors; of each qid and block of sentences the k best, which hold the k best of all.

    ``asked``: qid, title, q and more. ``sentences``: sid, title, v and more, vectors of any numbers. Scores are
    those of ``inner_products``; pairs are never rows, only the best leave a block.
    ``firsts``: (column, n): ``at.v`` is the vector of the first of each value of the column, for the n values that come
    first in a block; these hold the n that come first of all, so vectors needn't be fetched by another join.
    """
    kept = [f for f in asked.schema if f.name not in ("title", "q")] + [f for f in sentences.schema if f.name not in ("title", "v")]
    at = [StructField("at", StructType([sentences.schema["v"]]))] if firsts else []
    schema = StructType([*kept, StructField("score", DoubleType()), *at])
    left = [f.name for f in asked.schema if f.name not in ("title", "q")]
    right = [f.name for f in sentences.schema if f.name not in ("title", "v")]
    return _cells(asked, sentences, sizing, rows).applyInArrow(A.best(left, right, k, tie, DIGITS, firsts), schema)


def attention(asked: DataFrame, sentences: DataFrame) -> DataFrame:
    """(qid, dim, x): sentences weighted by the softmax of their scores with the question, dimensions from 1.

    Each block of sentences gives one row for a question: its best score, and the sums of
    weights and of weighted vectors relative to that.
    """
    kind = StructType([asked.schema["qid"], *[StructField(c, DoubleType()) for c in ("m", "z")], StructField("x", ArrayType(DoubleType()))])
    cells = _cells(asked.select("qid", "title", "q"), sentences.select("sid", "title", "v"), asked, 1)
    parts = cells.applyInArrow(A.attend(DIGITS), kind)
    # A question's parts are few, one for each block of its titles; gathered once, else each use would search anew.
    met = parts.groupBy("qid").agg(F.max("m").alias("best"), F.collect_list(F.struct("m", "z", "x")).alias("parts"))
    weight = lambda p: F.exp(p["m"] - F.col("best"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.coalesce(weight(p) * p["z"], F.lit(0.0)))
    each = met.select("qid", "best", total.alias("total"), F.explode("parts").alias("p"))
    each = each.select("qid", "total", weight(F.col("p")).alias("e"), F.posexplode("p.x").alias("i", "x"))
    summed = each.groupBy("qid", "total", "i").agg(F.sum(F.col("e") * F.col("x")).alias("x"))
    return summed.select("qid", (F.col("i") + 1).cast("long").alias("dim"), (F.col("x") / F.col("total")).alias("x"))


def one_hop(questions: DataFrame, candidates: DataFrame, sentences: DataFrame, k: int, spare: int = 4) -> DataFrame:
    """(qid, paragraph, score, rank): the best paragraphs among those of a question's candidate titles.

    ``questions``: qid, q. ``candidates``: qid, title. ``sentences``: sid, paragraph, title, v.
    """
    met = search(candidates.join(questions, "qid"), sentences, candidates, k * spare, ["sid"])
    return best_paragraphs(met, ["qid"], ["paragraph"], ["sid"], k, spare)


def _first_hop(questions: DataFrame, candidates: DataFrame, sentences: DataFrame, sizing: DataFrame, k: int, spare: int, rows: int) -> DataFrame:
    """(qid, paragraph, score, at, rank): as ``one_hop``, with the vector of each paragraph's best sentence in ``at``."""
    tie = ["sid", "paragraph"]  # a total order of paragraphs, so that each block's first ones hold the first of all
    met = search(candidates.join(questions, "qid"), sentences, sizing, k * spare, tie, rows, ("paragraph", k))
    cut = top_k(met, ["qid"], k * spare, tie)
    first = cut.groupBy("qid", "paragraph").agg(
        F.min("rank").alias("first_rank"), F.min_by("score", "rank").alias("score"), F.min_by("at", F.when(F.col("at").isNotNull(), F.col("rank"))).alias("at")
    )
    order = W.partitionBy("qid").orderBy("first_rank")
    best = first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    # All of these have it; said for uses that don't read it, else their plan would be another one and search anew.
    return best.where("at is not null").drop("first_rank")


def _second_hop(
    first: DataFrame, questions: DataFrame, candidates: DataFrame, sentences: DataFrame, sizing: DataFrame, k1: int, k2: int, spare: int, alpha: float,
) -> DataFrame:
    found = first.select("qid", F.col("paragraph").alias("p1"), F.col("score").alias("found"), F.col("at.v").alias("v"))
    # Of questions with one id, that with the path's score.
    met = inner_products(found.join(questions, "qid")).where(F.col("score").eqNullSafe(F.col("found")))
    at = met.groupBy("qid", "p1").agg(F.min(F.struct("q", "v")).alias("at"))
    paths = at.select("qid", "p1", V.reformulate(F.col("at.q"), F.col("at.v"), alpha).alias("q"))
    met = search(candidates.join(paths, "qid"), sentences, sizing, k2 * spare, ["p1", "sid"], k1).withColumnRenamed("paragraph", "p2")
    return best_paragraphs(met, ["qid"], ["p1", "p2"], ["p1", "sid"], k2, spare).select("qid", "p1", "p2", "score", "rank")


def two_hops(
    questions: DataFrame, candidates1: DataFrame, candidates2: DataFrame, sentences: DataFrame,
    k1: int, k2: int, spare: int = 4, alpha: float = 0.5, spare2: int | None = None, mixed: bool = False,
) -> DataFrame:
    """(qid, p1, p2, score, rank): pairs of paragraphs found by two searches.

    The first search keeps k1 paragraphs; each gives a new query, the question moved
    towards the paragraph's best sentence; the second search ranks all paths of a
    question together. A paragraph may follow itself. ``spare2``: spare of the second
    search, if it isn't that of the first. Both searches deal the sentences out alike, so these travel once.
    ``mixed``: (qid, hop, p1, p2, score, rank), the paragraphs of the first search too, without p2.
    """
    sizing = candidates2
    if candidates1 is not candidates2:
        sizing = candidates1.select("title").unionByName(candidates2.select("title"))
    first = _first_hop(questions, candidates1, sentences, sizing, k1, spare, k1)
    second = _second_hop(first, questions, candidates2, sentences, sizing, k1, k2, spare2 or spare, alpha)
    if not mixed:
        return second
    none = F.lit(None).cast(sentences.schema["paragraph"].dataType)
    one = first.select("qid", F.lit(1).alias("hop"), F.col("paragraph").alias("p1"), none.alias("p2"), "score", "rank")
    return one.unionByName(second.withColumn("hop", F.lit(2)))
