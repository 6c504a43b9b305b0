"""TF-IDF index and retrieval as joins and aggregates.

A corpus is (doc_id, text); its postings are (doc_id, term, tf). Term keys are the
n-grams themselves, so that unlike hashed buckets no two terms collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Scores are rounded before they are ranked, so that the order of summation can't decide a tie.
DIGITS = 6


Key = str | list[str]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def postings(corpus: DataFrame, key: Key = "doc_id", text: str = "text", n: int = 2, mode: str = "any") -> DataFrame:
    """(key, term, tf): counts of the n-grams that the filter keeps.

    With the filter ``any`` and n up to 2 each word is a row beside the next one, so
    that words are judged and joined in compiled code; other n-grams are made as arrays.
    """
    keys = _names(key)
    if mode != "any" or n > 2:
        grams = T.ngrams(T.tokens(F.coalesce(F.col(text), F.lit(""))), n, uncased=True, mode=mode)
        terms = corpus.select(*keys, F.explode(grams).alias("term"))
        return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    own = corpus.select(*keys, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    after = F.slice("_words", 2, F.greatest(F.lit(0), F.size("_words") - 1))
    pairs = own.select(*keys, F.inline(F.arrays_zip(F.col("_words").alias("w"), after.alias("next"))))
    pairs = pairs.select(*keys, F.lower("w").alias("w"), F.lower("next").alias("next")).where(~T.is_filtered_word(F.col("w")))
    terms = pairs.select(*keys, "w", F.when(~T.is_filtered_word(F.col("next")), F.concat("w", F.lit(" "), "next")).alias("pair"))
    # A word counts by itself and, where the next one stays too, with it.
    both = F.array("w", "pair") if n == 2 else F.array("w")
    return terms.select(*keys, F.explode(both).alias("term")).where("term is not null").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df) of postings that hold each (document, term) once.

    The count looks at tf, which is never 0: were tf not used here, the optimizer would
    prune it, and a plan that needs the postings for weights too would make them twice.
    """
    return index.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))


def idf(df: Column, n: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5)), at least 0."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def weighted(index: DataFrame, df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Postings with ``weight`` = ln(1 + tf) * idf. ``n_docs``: one row, n."""
    rated = df.join(F.broadcast(n_docs)).select("term", idf(F.col("df"), F.col("n")).alias("idf"))  # one row is broadcast
    return index.join(rated, "term").withColumn("weight", F.log1p("tf") * F.col("idf"))


def count_documents(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n"))


def scores(queries: DataFrame, index: DataFrame, corpus: DataFrame, doc: str = "doc_id", qid: str = "qid") -> DataFrame:
    """(qid, doc, score) of all pairs that share a weighted term.

    ``queries``: postings of the questions. Only the index's terms that a question has
    are weighted; those of weight 0 are dropped before the join that multiplies rows.
    """
    asked = queries.select("term").distinct()
    held = index.join(asked, "term", "left_semi")
    rated = document_frequency(held).join(F.broadcast(count_documents(corpus)))
    rated = rated.select("term", idf(F.col("df"), F.col("n")).alias("idf")).where("idf > 0")
    right = held.join(rated, "term").select("term", doc, (F.log1p("tf") * F.col("idf")).alias("dw"))
    left = queries.join(rated, "term").select("term", qid, (F.log1p("tf") * F.col("idf")).alias("qw"))
    return right.join(left, "term").groupBy(qid, doc).agg(F.round(F.sum(F.col("qw") * F.col("dw")), DIGITS).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each group with ``rank`` from 1; ties go to the smaller id."""
    order = W.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def smooth_idf(index: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1. ``n_docs``: one row, n."""
    counted = document_frequency(index).join(F.broadcast(n_docs))  # one row is broadcast
    return counted.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def unit_vectors(index: DataFrame, key: Key, rated: DataFrame) -> DataFrame:
    """Postings with ``weight`` = tf * idf, scaled to length 1 in each ``key``."""
    keys = _names(key)
    raw = index.join(rated, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, keys).select(*keys, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def cosine_distance(left: DataFrame, right: DataFrame, left_key: Key, right_key: Key) -> DataFrame:
    """1 minus the sum of products, of pairs that share a term; never -0.0."""
    a = left.select(*_names(left_key), "term", F.col("weight").alias("lw"))
    b = right.select(*_names(right_key), "term", F.col("weight").alias("rw"))
    product = F.sum(F.col("lw") * F.col("rw"))
    return a.join(b, "term").groupBy(*_names(left_key), *_names(right_key)).agg((F.round(1 - product, DIGITS) + 0.0).alias("distance"))
