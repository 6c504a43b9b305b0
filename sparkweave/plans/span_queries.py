"""Spans: order lines stand for the tokens of an order, numbered by a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import spans as S
from ..functions import text as T
from ..operators import spans as O
from ..registry import query, table
from . import sql

_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
_TOKENS = """t AS (SELECT l_orderkey AS q, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS pos,
  l_quantity / 50 AS p_start, l_discount * 10 AS p_end, l_linenumber FROM lineitem)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_KEY)) - 1
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("q"), pos.alias("pos"), (F.col("l_quantity") / 50).alias("p_start"), (F.col("l_discount") * 10).alias("p_end"), "l_linenumber",
    )


def _best(group: str = "q", within: str = "TRUE", score: str = "a.p_start * b.p_end") -> str:
    return f"""WITH {_TOKENS}, p AS (SELECT a.q, a.l_linenumber, a.pos AS s, b.pos AS e, {score} AS score FROM t a JOIN t b ON a.q = b.q AND b.pos >= a.pos AND {within}),
r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, e, s) AS n FROM p)
SELECT {group}, s AS "start", e AS "end", round(score, 6) AS score FROM r WHERE n = 1"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN n = 0 THEN 0 ELSE 2 * n / (3 + size) END, 6) AS f1, count(*) AS copies FROM (
SELECT *, greatest(0, least(4, l_linenumber + CAST(l_quantity AS INT) % 4) - greatest(2, l_linenumber) + 1) AS n, CAST(l_quantity AS INT) % 4 + 1 AS size FROM lineitem)
GROUP BY ALL""")
def X01_span_f1(spark: SparkSession, d: str) -> DataFrame:
    end = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4
    f1 = F.round(S.overlap_f1(F.lit(2), F.lit(4), F.col("l_linenumber"), end), 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", f1.alias("f1")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "f1").agg(F.count("*").alias("copies"))


@query(_best())
def X02_best_span(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(O.best_span(_tokens(spark, d), ["q"]))


@query(_best(within="b.pos - a.pos < 3"))
def X03_best_span_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(O.best_span(_tokens(spark, d), ["q"], bound=3))


@query(_best(group="q, l_linenumber", within="a.l_linenumber = b.l_linenumber"))
def X04_best_span_in_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(O.best_span(_tokens(spark, d), ["q", "l_linenumber"]))


@query(_best(group="q, l_linenumber", within="a.l_linenumber = b.l_linenumber AND a.pos < 4 AND b.pos < 4"))
def X05_best_span_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Positions beyond the fourth are cut."""
    return _rounded(O.best_span(_tokens(spark, d).where("pos < 4"), ["q", "l_linenumber"]))


_APART = "(b.s > a{0}.e OR b.e < a{0}.s)"


@query(f"""WITH {_TOKENS}, p AS (SELECT a.q, a.pos AS s, b.pos AS e, round(a.p_start * b.p_end, 6) AS score FROM t a JOIN t b ON a.q = b.q AND b.pos >= a.pos AND b.pos - a.pos < 3),
a1 AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, s, e) = 1),
a2 AS (SELECT b.* FROM p b JOIN a1 USING (q) WHERE {_APART.format(1)} QUALIFY row_number() OVER (PARTITION BY b.q ORDER BY b.score DESC, b.s, b.e) = 1),
a3 AS (SELECT b.* FROM p b JOIN a1 USING (q) JOIN a2 USING (q) WHERE {_APART.format(1)} AND {_APART.format(2)} QUALIFY row_number() OVER (PARTITION BY b.q ORDER BY b.score DESC, b.s, b.e) = 1)
SELECT q, s, e, score, 1 AS rank FROM a1 UNION ALL SELECT q, s, e, score, 2 AS rank FROM a2 UNION ALL SELECT q, s, e, score, 3 AS rank FROM a3""")
def X06_disjoint_spans(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    ends = t.select("q", F.col("pos").alias("e"), "p_end")
    spans = t.select("q", F.col("pos").alias("s"), "p_start").join(ends, "q").where("e >= s and e - s < 3")
    return O.disjoint_spans(spans.select("q", "s", "e", F.round(F.col("p_start") * F.col("p_end"), 6).alias("score")), "q", 3, 3)


@query(_best(within="b.pos - a.pos < 4", score="a.p_start + b.p_end"))
def X07_best_span_logits(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(O.best_span(_tokens(spark, d), ["q"], bound=4, additive=True))


@query(f"""WITH {_TOKENS}, n AS (SELECT q, max(pos) + 1 AS n FROM t GROUP BY q)
SELECT a.q, a.pos AS s, b.pos AS e, CAST((b.pos - a.pos) * n - ((b.pos - a.pos) * (b.pos - a.pos - 1)) // 2 + a.pos AS BIGINT) AS packed
FROM t a JOIN t b ON a.q = b.q AND b.pos >= a.pos AND b.pos - a.pos < 3 JOIN n ON n.q = a.q""")
def X08_packed_spans(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).select("q", "pos")
    sized = t.join(t.groupBy("q").agg((F.max("pos") + 1).alias("n")), "q")
    met = sized.withColumnRenamed("pos", "s").join(t.withColumnRenamed("pos", "e"), "q").where("e >= s and e - s < 3")
    return met.select("q", "s", "e", S.pack(F.col("s"), F.col("e"), F.col("n"), 3).alias("packed"))


@query(f"WITH {_TOKENS} SELECT q, round(avg(p_start) FILTER (WHERE pos < 5), 6) AS mean, round(exp(max(p_start) + max(p_end)), 6) AS outer_score FROM t GROUP BY q")
def X09_masked_mean(spark: SparkSession, d: str) -> DataFrame:
    mean = F.avg(F.when(F.col("pos") < 5, F.col("p_start")))
    return _tokens(spark, d).groupBy("q").agg(F.round(mean, 6).alias("mean"), F.round(F.exp(F.max("p_start") + F.max("p_end")), 6).alias("outer_score"))


@query("SELECT event_id, CASE WHEN value >= 10 THEN event_type WHEN event_id % 3 >= event_id % 2 THEN 'yes' ELSE 'no' END AS answer FROM events")
def X10_answer_choice(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    answer = S.answer_text(F.col("event_type"), F.col("value"), F.lit(10.0), e % 2, e % 3)
    return table(spark, d, "events").select("event_id", answer.alias("answer"))


_SKIP = "'a', 'an', 'the', ''"


@query(f"""WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {sql.tokens('text')} AS l FROM documents)),
n AS (SELECT doc_id, pos, trim(lower(w), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~‘’´') AS w FROM w),
k AS (SELECT doc_id, pos, w, lead(w) OVER o AS w2, lead(pos) OVER o AS pos2 FROM n WHERE w NOT IN ({_SKIP}) WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS n, CAST(min(pos) AS INT) AS first_start, CAST(min(pos2) AS INT) AS first_end FROM k WHERE w = 'of' AND w2 = 'and' GROUP BY doc_id""")
def J32_answer_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where "of the and" or "of and" stands, articles skipped, in all documents."""
    answers = F.array(F.array(F.lit("of"), F.lit("the"), F.lit("and")))
    rows = table(spark, d, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("words"), answers.alias("answers"))
    found = O.answer_spans(rows, ["doc_id"], "words", "answers")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.min("end").alias("first_end"))
