"""TF-IDF of all terms of all texts, by blocks of texts.

Postings of a whole corpus are many times its size. Here the texts are dealt out in
blocks once; a block asks for the document frequencies of its distinct terms, by 64-bit
keys of which many stand in a row, and gets back numbers in the same order. Sorted keys
travel as the steps between them. Two terms share a key with odds of 2^-64.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow_terms as A
from ..functions import text as T

#: Characters of a block on average, and blocks for each bucket of keys.
CHARS, SHARE = 1 << 23, 4
ASKS, ANSWERS = "block int, bucket int, keys binary, counts binary", "block int, bucket int, dfs binary"


def _keys(text: Column) -> Column:
    """Keys of the lower-cased words."""
    return F.transform(T.tokens(text), lambda w: F.xxhash64(F.lower(w)))


def _dropped(spark: SparkSession) -> np.ndarray:
    """Keys of the words that the filter drops: stop words, and marks that the JVM takes for punctuation, tokens of their own."""
    marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "P"]
    words = spark.range(1).select(F.explode(F.split(F.lit(" ".join([*T.STOPWORDS, *marks])), " ")).alias("w")).where(T.is_filtered_word(F.col("w")))
    return np.array(sorted(r[0] for r in words.select(F.xxhash64(F.lower("w"))).collect()), np.int64)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _size(corpus: DataFrame, text: str) -> tuple[int, int, int]:
    """Blocks, texts and lines."""
    own = F.coalesce(F.col(text), F.lit(""))
    row = corpus.agg(F.sum(F.length(own).cast("long")), F.count("*"), F.sum(F.size(_lines(own)))).first()
    return max(1, -(-(row[0] or 0) // CHARS)), row[1], row[2] or 0


def _dealt(corpus: DataFrame, key: str, text: str, block: Column, by_line: bool) -> DataFrame:
    """(block, id, words): the texts travel, keys of words are made after that."""
    own = corpus.select(block.cast("int").alias("block"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = F.transform(_lines(F.col("text")), _keys) if by_line else F.array(_keys(F.col("text")))
    return own.repartition("block").select("block", "id", words.alias("words"))


def _hashed(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _answers(asks: DataFrame) -> DataFrame:
    return asks.groupBy("bucket").applyInArrow(A.answer, ANSWERS)


def first_line_distances(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, distance): cosine distance of each line, from 2, to the first line of its text, where they share a term.

    Units of the idf are lines. ``corpus`` is read while the plan is built, for its size.
    """
    blocks, _, lines = _size(corpus, text)
    buckets, dropped = -(-blocks // SHARE), _dropped(corpus.sparkSession)
    own = _dealt(corpus, key, text, _hashed(key, blocks), by_line=True)
    answers = _answers(own.groupBy("block").applyInArrow(A.ask(buckets, dropped), ASKS))
    kind = f"id {corpus.schema[key].dataType.simpleString()}, i long, product double"
    met = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(A.first_line_products(buckets, lines, dropped), kind)
    return met.select(F.col("id").alias(key), "i", (F.round(1 - F.col("product"), 6) + 0.0).alias("distance"))  # -0.0 is made 0.0


class Index:
    """A corpus dealt out in blocks, for several searches: its texts and its asks travel once in a plan.

    ``corpus`` is read while the plan is built, for its size. Units are lines or texts.
    """

    def __init__(self, corpus: DataFrame, by_line: bool, key: str = "doc_id", text: str = "text"):
        self.blocks, texts, lines = _size(corpus, text)
        self.n, self.by_line, self.key = lines if by_line else texts, by_line, key
        self.buckets, self.dropped = -(-self.blocks // SHARE), _dropped(corpus.sparkSession)
        self.kind = corpus.schema[key].dataType.simpleString()
        self.own = _dealt(corpus, key, text, _hashed(key, self.blocks), by_line)
        self.asks = self.asked(self.own)
        self.answers = _answers(self.asks)

    def asked(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("block").applyInArrow(A.ask(self.buckets, self.dropped), ASKS)

    def best(self, questions: DataFrame, k: int, qid: str = "qid", text: str = "text", wanted: DataFrame | None = None, parts: int | None = None) -> DataFrame:
        """(qid, key, i, product, wanted): of each question and block the k best units, which hold the k best of all.

        Questions ask for frequencies as blocks below 0; then all of them go to every block, packed.
        ``wanted``: pairs (qid, key) whose product is given besides, if not 0.
        ``parts``: blocks of questions; without it they are read for their size while the plan is built.
        """
        weigh = A.smooth_weights if self.by_line else A.log_weights
        asked = _dealt(questions, qid, text, -1 - _hashed(qid, parts or _size(questions, text)[0]), by_line=False)
        told = self.asks.groupBy("bucket").cogroup(self.asked(asked).groupBy("bucket")).applyInArrow(A.answer_questions, ANSWERS)
        qkind = questions.schema[qid].dataType.simpleString()
        packed = A.pack(self.buckets, self.n, weigh, self.dropped)
        kind = f"bucket int, qids array<{qkind}>, places binary, keys binary, weights binary"
        packs = asked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(packed, kind)
        packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        right = self.answers.unionByName(packs, allowMissingColumns=True)
        none = F.lit(None)
        if wanted is None:
            right = right.withColumns({"wid": none.cast(self.kind), "wqid": none.cast(qkind)})
        else:
            at = _hashed(self.key, self.blocks).cast("int").alias("block")
            pairs = wanted.select(at, F.lit(-2).alias("bucket"), F.col(self.key).alias("wid"), F.col(qid).alias("wqid"))
            right = right.unionByName(pairs, allowMissingColumns=True)
        cell = A.best(self.buckets, self.n, k, weigh, self.by_line, self.dropped)
        kind = f"qid {qkind}, id {self.kind}, i long, product double, wanted boolean"
        met = self.own.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(cell, kind)
        return met.withColumnsRenamed({"qid": qid, "id": self.key})


def nearest_lines(questions: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, i, distance): cosine distances with the idf of lines, the k smallest of each question among them."""
    met = Index(corpus, by_line=True).best(questions, k)
    return met.select("qid", "doc_id", "i", (F.round(1 - F.col("product"), 6) + 0.0).alias("distance"))


def best_texts(questions: DataFrame, index: Index, k: int, wanted: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(qid, doc_id, score, wanted): scores of ``tfidf.scores``, the k best of each question among those not flagged as wanted."""
    return index.best(questions, k, wanted=wanted, parts=parts).select("qid", "doc_id", F.round("product", 6).alias("score"), "wanted")
