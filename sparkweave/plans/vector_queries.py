"""Vector search over the embeddings: every vector whose id 20 divides is a question, all vectors are sentences.

Four sentences make a paragraph; labels are titles; a question's candidates are the
paragraphs of its own title and the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import vectors as O
from ..registry import query, table

K1, K2, SPARE = 4, 10, 4


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    paragraph = F.floor(F.col("vec_id") / 4)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), paragraph.alias("paragraph"), F.col("label").alias("title"), v.alias("v"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).where("sid % 20 = 0").select(F.col("sid").alias("qid"), F.col("v").alias("q"), F.col("title").alias("own"))


def _candidates(spark: SparkSession, d: str, n: int = 2) -> DataFrame:
    titles = F.array(*[(F.col("own") + i) % 10 for i in range(n)])
    return _questions(spark, d).select("qid", F.explode(titles).alias("title"))


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, q) and sentences for searches by blocks; vectors travel as they are stored, and count as doubles there."""
    e = table(spark, d, "embeddings")
    sentences = e.select(F.col("vec_id").alias("sid"), F.floor(F.col("vec_id") / 4).alias("paragraph"), F.col("label").alias("title"), F.col("embedding").alias("v"))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), sentences


def _scored(spark: SparkSession, d: str) -> DataFrame:
    met = _candidates(spark, d).join(_questions(spark, d), "qid").join(_sentences(spark, d), "title")
    return O.inner_products(met)


_BASE = """
s AS (SELECT vec_id AS sid, vec_id // 4 AS paragraph, label AS title, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT sid AS qid, v AS q, title AS own FROM s WHERE sid % 20 = 0),
c AS (SELECT qid, q, s.* FROM q JOIN s ON s.title = own OR s.title = (own + 1) % 10),
scored AS (SELECT qid, q, sid, paragraph, title, v, round(list_dot_product(q, v), 6) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sid) AS rank FROM scored)"""


def _hop1(k1: int, spare: int) -> str:
    return f"""{_BASE},
h AS (SELECT qid, paragraph, min(rank) AS fr, max(score) AS score, arg_min(q, rank) AS q, arg_min(v, rank) AS v FROM r WHERE rank <= {k1 * spare} GROUP BY ALL),
hop1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fr) AS rank FROM h) WHERE rank <= {k1})"""


def _hop2(k1: int, k2: int, spare: int, spare2: int) -> str:
    return f"""{_hop1(k1, spare)},
paths AS (SELECT hop1.qid, paragraph AS p1, own, list_transform(list_zip(hop1.q, v), lambda z: z[1] + 0.5 * z[2]) AS q2 FROM hop1 JOIN q ON q.qid = hop1.qid),
m AS (SELECT qid, p1, paragraph AS p2, sid, round(list_dot_product(q2, v), 6) AS score FROM paths JOIN s ON s.title = own OR s.title = (own + 1) % 10),
m2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p1, sid) AS rank FROM m),
g AS (SELECT qid, p1, p2, min(rank) AS fr, max(score) AS score FROM m2 WHERE rank <= {k2 * spare2} GROUP BY ALL),
hop2 AS (SELECT * FROM (SELECT qid, p1, p2, score, row_number() OVER (PARTITION BY qid ORDER BY fr) AS rank FROM g) WHERE rank <= {k2})"""


_HOP1, _HOP2 = _hop1(K1, SPARE), _hop2(K1, K2, SPARE, SPARE)


@query(f"WITH {_BASE} SELECT qid, sid, score, rank FROM r WHERE rank <= 10")
def V01_mips_top_k(spark: SparkSession, d: str) -> DataFrame:
    return O.top_k(_scored(spark, d), ["qid"], 10, ["sid"]).select("qid", "sid", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BASE} SELECT qid, sid, score FROM scored ORDER BY score DESC, qid, sid LIMIT 50")
def V02_global_top_k(spark: SparkSession, d: str) -> DataFrame:
    return O.top_k(_scored(spark, d), [], 50, ["qid", "sid"]).select("qid", "sid", "score")


#: Weights of the linear layer: 64 dimensions each, from a rule.
_W = [[((i * 7 + k * 3) % 11 - 5) / 10 for i in range(64)] for k in range(3)]
_W_DOT = 0.3


def _weights():
    return [F.array(*map(F.lit, w)) for w in _W]


_FOLD = ", ".join(f"{w}::DOUBLE[] AS w{i}" for i, w in enumerate(_W))


@query(f"""WITH {_BASE}, w AS (SELECT {_FOLD}),
f AS (SELECT qid, sid, round(list_dot_product(v, list_transform(list_zip(w0, w1, w2, q), lambda z: z[1] + z[2] + z[3] * z[4] + {_W_DOT} * z[4])), 6) AS score FROM scored, w)
SELECT qid, sid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sid) AS rank FROM f) WHERE rank <= 10""")
def V03_fold_search_vector(spark: SparkSession, d: str) -> DataFrame:
    folded = _questions(spark, d).withColumn("q", V.fold_query(F.col("q"), *_weights(), _W_DOT))
    met = _candidates(spark, d).join(folded, "qid").join(_sentences(spark, d), "title")
    return O.top_k(O.inner_products(met), ["qid"], 10, ["sid"]).select("qid", "sid", "score")


@query(f"""WITH {_BASE}, w AS (SELECT {_FOLD}),
f AS (SELECT qid, paragraph, list_dot_product(v, w0) + list_dot_product(list_transform(list_zip(v, q), lambda z: z[1] - z[2]), w1)
  + list_dot_product(list_transform(list_zip(v, q), lambda z: z[1] * z[2]), w2) + {_W_DOT} * list_dot_product(v, q) AS x FROM scored, w)
SELECT qid, paragraph, round(max(x), 6) AS score FROM f GROUP BY ALL""")
def V04_merged_paragraph_score(spark: SparkSession, d: str) -> DataFrame:
    score = V.merged_score(F.col("v"), F.col("q"), *_weights(), _W_DOT)
    return _scored(spark, d).groupBy("qid", "paragraph").agg(F.round(F.max(score), 6).alias("score"))


@query("""WITH x AS (SELECT vec_id // 4 AS paragraph, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT paragraph, i AS dim, round(max(x), 6) AS top FROM x GROUP BY ALL""")
def V05_segment_max(spark: SparkSession, d: str) -> DataFrame:
    each = _sentences(spark, d).select("paragraph", F.posexplode("v").alias("i", "x"))
    return each.groupBy("paragraph", (F.col("i") + 1).cast("long").alias("dim")).agg(F.round(F.max("x"), 6).alias("top"))


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i, vec_id % 3 <> 0 AS kept FROM embeddings)
SELECT label, i AS dim, round(greatest(max(x) FILTER (WHERE kept), 0.05), 6) AS top, round(avg(x) FILTER (WHERE kept), 6) AS mean FROM x GROUP BY ALL""")
def V06_masked_pool(spark: SparkSession, d: str) -> DataFrame:
    each = _sentences(spark, d).select("title", (F.col("sid") % 3 != 0).alias("kept"), F.posexplode("v").alias("i", "x"))
    x = F.when(F.col("kept"), F.col("x"))
    out = each.groupBy(F.col("title").alias("label"), (F.col("i") + 1).cast("long").alias("dim"))
    return out.agg(F.round(F.greatest(F.max(x), F.lit(0.05)), 6).alias("top"), F.round(F.avg(x), 6).alias("mean"))


@query(f"""WITH {_BASE}, e AS (SELECT qid, sid, v, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM scored),
p AS (SELECT qid, v, e / sum(e) OVER (PARTITION BY qid) AS p FROM e),
x AS (SELECT qid, p, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p)
SELECT qid, i AS dim, round(sum(p * x), 5) AS x FROM x GROUP BY ALL""")
def V07_attention_reformulate(spark: SparkSession, d: str) -> DataFrame:
    """Sentences weighted by the softmax of their scores."""
    asked = _candidates(spark, d).join(_questions(spark, d).drop("own"), "qid")
    return O.attention(asked, _sentences(spark, d)).withColumn("x", F.round("x", 5))


@query(f"WITH {_BASE} SELECT qid, sid, round(list_dot_product(q, v) / 8, 6) AS scaled, round(list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)), 6) AS cosine FROM scored")
def V10_similarities(spark: SparkSession, d: str) -> DataFrame:
    cosine = V.dot(F.col("q"), F.col("v")) / F.sqrt(V.dot(F.col("q"), F.col("q")) * V.dot(F.col("v"), F.col("v")))
    return _scored(spark, d).select("qid", "sid", F.round(V.dot(F.col("q"), F.col("v")) / 8.0, 6).alias("scaled"), F.round(cosine, 6).alias("cosine"))


@query("SELECT user_id, round(max(value) + ln(sum(exp(value - m))), 6) AS lse FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def V12_log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    shifted = table(spark, d, "events").withColumn("m", F.max("value").over(W.partitionBy("user_id")))
    return shifted.groupBy("user_id").agg(F.round(F.max("value") + F.log(F.sum(F.exp(F.col("value") - F.col("m")))), 6).alias("lse"))


@query("""SELECT user_id, round(greatest(1 - coalesce(avg(value) FILTER (WHERE event_type = 'purchase'), 0) + coalesce(avg(value) FILTER (WHERE event_type <> 'purchase'), 0), 0), 6) AS loss
FROM events GROUP BY user_id""")
def V13_pairwise_margin(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("value"))), F.lit(0.0))
    gold = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.greatest(1 - mean(gold) + mean(~gold), F.lit(0.0)), 6).alias("loss"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN -1e29::DOUBLE ELSE value END AS masked FROM events")
def V14_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit(-1e29)).otherwise(F.col("value")).alias("masked"))


@query("""WITH p AS (SELECT event_id, 1 / (1 + exp(-value / 100)) AS a, 1 / (1 + exp(value / 200)) AS b FROM events)
SELECT event_id, round(ln(a * b / (1 - a * b)), 6) AS logit FROM p""")
def V15_multiply_in_logit_space(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").selectExpr("event_id", "1 / (1 + exp(-value / 100)) * (1 / (1 + exp(value / 200))) as p")
    return p.select("event_id", F.round(F.log(F.col("p") / (1 - F.col("p"))), 6).alias("logit"))


@query(f"WITH {_BASE} SELECT qid, count(*) AS n, count(DISTINCT paragraph) AS n_paragraphs FROM c GROUP BY qid")
def J18_candidate_fetch(spark: SparkSession, d: str) -> DataFrame:
    met = _candidates(spark, d).join(_sentences(spark, d), "title")
    return met.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("paragraph").alias("n_paragraphs"))


@query(f"WITH {_HOP1} SELECT qid, paragraph, score, rank FROM hop1")
def J19_hop1_mips(spark: SparkSession, d: str) -> DataFrame:
    return O.one_hop(_questions(spark, d).drop("own"), _candidates(spark, d), _sentences(spark, d), K1, SPARE).drop("first_rank")


def _two_hops(spark: SparkSession, d: str, k1: int = K1, k2: int = K2, spare: int = SPARE, **more) -> DataFrame:
    c, (questions, sentences) = _candidates(spark, d), _stored(spark, d)
    return O.two_hops(questions, c, c, sentences, k1, k2, spare, **more)


@query(f"WITH {_HOP2} SELECT qid, p1, p2, score, rank FROM hop2")
def J21_two_hop_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _two_hops(spark, d)


@query(f"WITH {_hop2(8, 45, 4, 4)} SELECT qid, p1, p2, score, rank FROM hop2")
def J22_two_hop_wide(spark: SparkSession, d: str) -> DataFrame:
    """The per-question form with stored vectors, at its wide settings."""
    return _two_hops(spark, d, 8, 45, 4)


@query(f"WITH {_hop2(5, 20, 2, 5)} SELECT qid, p1, p2, score, rank FROM hop2")
def J23_two_hop_older(spark: SparkSession, d: str) -> DataFrame:
    """The older form: twice k1 sentences in the first search, k1 times k2 in the second."""
    return _two_hops(spark, d, 5, 20, 2, spare2=5)


@query(f"WITH {_HOP2} SELECT qid, count(*) AS n_paths, count(DISTINCT p2) AS n_second, max(score) AS best FROM hop2 GROUP BY qid")
def J20_hop2_paths(spark: SparkSession, d: str) -> DataFrame:
    return _two_hops(spark, d).groupBy("qid").agg(F.count("*").alias("n_paths"), F.countDistinct("p2").alias("n_second"), F.max("score").alias("best"))


@query(f"WITH {_HOP1}, t AS (SELECT qid, paragraph, rank FROM hop1) SELECT t.qid, t.paragraph, t.rank, count(*) AS n_sentences FROM t JOIN s ON s.paragraph = t.paragraph GROUP BY ALL")
def J24_one_hop_texts(spark: SparkSession, d: str) -> DataFrame:
    found = O.one_hop(_questions(spark, d).drop("own"), _candidates(spark, d), _sentences(spark, d), K1, SPARE)
    met = found.select("qid", "paragraph", "rank").join(_sentences(spark, d).select("paragraph"), "paragraph")
    return met.groupBy("qid", "paragraph", "rank").agg(F.count("*").alias("n_sentences"))


@query(f"""WITH {_BASE}, r2 AS (SELECT *, row_number() OVER (PARTITION BY qid, title ORDER BY score DESC, sid) AS rk FROM scored),
h AS (SELECT qid, title, paragraph, min(rk) AS fr, max(score) AS score FROM r2 WHERE rk <= 6 GROUP BY ALL)
SELECT qid, title, paragraph, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, title ORDER BY fr) AS rank FROM h) WHERE rank <= 3""")
def J25_one_hop_per_title(spark: SparkSession, d: str) -> DataFrame:
    return O.best_paragraphs(_scored(spark, d), ["qid", "title"], ["paragraph"], ["sid"], 3, 2).drop("first_rank")


@query(f"WITH {_HOP2} SELECT qid, 1 AS hop, paragraph AS p1, NULL::BIGINT AS p2, rank FROM hop1 UNION ALL SELECT qid, 2 AS hop, p1, p2, rank FROM hop2")
def J26_mixed_hops(spark: SparkSession, d: str) -> DataFrame:
    return _two_hops(spark, d, mixed=True).select("qid", "hop", "p1", "p2", "rank")


@query(f"WITH {_BASE}, f AS (SELECT qid, paragraph, min(rank) AS fr FROM r GROUP BY ALL) SELECT qid, paragraph, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fr, paragraph) AS rank FROM f) WHERE rank <= 5")
def W06_first_seen(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.desc("score"), "sid")
    ranked = _scored(spark, d).withColumn("rank", F.row_number().over(order))
    return R.first_seen(ranked, ["qid"], ["paragraph"], 5).select("qid", "paragraph", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_HOP2}, gold AS (SELECT q.qid, g FROM q, (VALUES (0), (1)) AS v(k), LATERAL (SELECT (q.qid // 4) + k AS g)),
ks AS (SELECT unnest(range(1, {K2} + 1)) AS k),
f AS (SELECT gold.qid, g, min(rank) FILTER (WHERE p1 = g OR p2 = g) AS fr FROM gold LEFT JOIN hop2 ON hop2.qid = gold.qid GROUP BY ALL),
per AS (SELECT k, qid, avg(coalesce(fr <= k, false)::int) AS hits, max(coalesce(fr <= k, false)::int) AS any_hit FROM f, ks GROUP BY ALL)
SELECT k, round(avg(hits), 6) AS hits, round(avg(any_hit), 6) AS at_least_one FROM per GROUP BY k""")
def A17_pair_stats_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Gold paragraphs of a question: its own and the next one. Means over questions for each k."""
    gold = _questions(spark, d).select("qid", F.explode(F.array(F.floor(F.col("qid") / 4), F.floor(F.col("qid") / 4) + 1)).alias("g"))
    paths = _two_hops(spark, d).select("qid", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("g"), "rank")
    first = gold.join(paths.groupBy("qid", "g").agg(F.min("rank").alias("fr")), ["qid", "g"], "left")
    at = first.select("qid", "fr", F.explode(F.sequence(F.lit(1), F.lit(K2))).alias("k"))
    hit = F.coalesce(F.col("fr") <= F.col("k"), F.lit(False)).cast("int")
    per = at.groupBy("k", "qid").agg(F.avg(hit).alias("hits"), F.max(hit).alias("any"))
    return per.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.avg("hits"), 6).alias("hits"), F.round(F.avg("any"), 6).alias("at_least_one"))
