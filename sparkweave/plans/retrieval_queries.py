"""Index, retrieval, distractors, alignment and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import term_blocks, tfidf
from ..registry import query, table
from . import sql

K = 10


def _index(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.postings(table(spark, d, "documents"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").withColumnRenamed("item_id", "qid")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    asked = tfidf.postings(_questions(spark, d), "qid")
    return tfidf.scores(asked, _index(spark, d), table(spark, d, "documents"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    from .text_queries import P08_answer_in_text

    return P08_answer_in_text(spark, d).withColumnRenamed("item_id", "qid")


_GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH dp AS ({sql.postings('documents', 'doc_id')}) SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams FROM dp GROUP BY doc_id")
def J01_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_grams"))


@query(f"WITH dp AS ({sql.postings('documents', 'doc_id')}) SELECT count(*) AS n_entries, CAST(sum(tf) AS BIGINT) AS total, count(DISTINCT term) AS n_terms FROM dp")
def J02_term_matrix(spark: SparkSession, d: str) -> DataFrame:
    by_term = _index(spark, d).groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    return by_term.agg(F.sum("n").alias("n_entries"), F.sum("tf").alias("total"), F.count("*").alias("n_terms"))


@query(f"WITH {sql.SCORES} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= {K}")
def J03_tfidf_top_k(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_k(_scores(spark, d), K).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {sql.SCORES} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 64")
def J04_batch_top_k(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_k(_scores(spark, d), 64).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {sql.SCORES}, {_GOLD}
SELECT g.qid, g.doc_id, coalesce(score, 0.0) AS score FROM gold g LEFT JOIN scores s ON s.qid = g.qid AND s.doc_id = g.doc_id""")
def J05_pair_score(spark: SparkSession, d: str) -> DataFrame:
    met = _gold(spark, d).join(_scores(spark, d), ["qid", "doc_id"], "left")
    return met.select("qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"""WITH {sql.SCORES}, {_GOLD}
SELECT s.qid, s.doc_id, score, g.doc_id IS NOT NULL AS is_gold FROM scores s LEFT JOIN gold g ON s.qid = g.qid AND s.doc_id = g.doc_id
WHERE s.qid IN (SELECT qid FROM gold)""")
def J07_own_paragraph_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d).withColumn("is_gold", F.lit(True))
    asked = _scores(spark, d).join(gold.select("qid").distinct(), "qid", "left_semi")
    return asked.join(gold, ["qid", "doc_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


_LINES = """lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
#: A line is named by its document and its number in it, from 1.
LINE = ["doc_id", "i"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs: the documents' lines, numbered."""
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    return parts.select("doc_id", (F.col("at").cast("long") + 1).alias("i"), "text")


def _unit(index: str, key: str, idf: str) -> str:
    return f"""(SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
      FROM (SELECT {key}, term, tf * idf AS raw FROM {index} JOIN {idf} USING (term)))"""


@query(f"""WITH dp AS ({sql.postings('documents', 'doc_id')}), qp AS ({sql.postings("(SELECT item_id AS qid, text FROM benchmark)", "qid")}),
one AS (SELECT DISTINCT term, 1.0 AS idf FROM qp), q AS {_unit('qp', 'qid', 'one')},
x AS (SELECT qid, doc_id, dp.term, dp.tf FROM dp JOIN (SELECT qid, term FROM qp) USING (term)),
r AS (SELECT qid, doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY qid, doc_id)) AS w FROM x),
s AS (SELECT r.qid, doc_id, round(1 - sum(w * q.weight), 6) + 0.0 AS distance FROM r JOIN q ON q.qid = r.qid AND q.term = r.term GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank FROM s)
SELECT qid, doc_id, distance, rank FROM k WHERE rank <= {K}""")
def J08_question_cosine_rank(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of a question and each document over the question's own terms, whose idf is then constant."""
    asked = tfidf.postings(_questions(spark, d), "qid")
    own = _index(spark, d).join(asked.select("qid", "term", F.col("tf").alias("q_tf")), "term")
    pairs = own.groupBy("qid", "doc_id").agg(
        F.sum(F.col("tf") * F.col("q_tf")).alias("dot"), F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("norm")
    )
    norms = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("q_norm"))
    distance = F.round(1 - F.col("dot") / (F.col("norm") * F.col("q_norm")), 6) + 0.0
    scored = pairs.join(norms, "qid").select("qid", "doc_id", distance.alias("distance"))
    order = W.partitionBy("qid").orderBy("distance", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= K)


def _line_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each line to the first line of its document; no other pairs are formed."""
    return term_blocks.first_line_distances(table(spark, d, "documents"))


_LINE_COSINES = f"""{_LINES}, lp AS ({sql.postings('lines', 'doc_id, i')}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM lines)) / (1 + count(*))) + 1 AS idf FROM lp GROUP BY term),
unit AS {_unit('lp', 'doc_id, i', 'idf')},
cos AS (SELECT b.doc_id, b.i, round(1 - sum(a.weight * b.weight), 6) + 0.0 AS distance
  FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id = b.doc_id AND a.i = 1 AND b.i <> 1 GROUP BY ALL)"""


@query(f"WITH {_LINE_COSINES} SELECT doc_id, count(*) AS n_near, min(distance) AS best FROM cos GROUP BY doc_id")
def J09_within_document_rank(spark: SparkSession, d: str) -> DataFrame:
    return _line_cosines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_near"), F.min("distance").alias("best"))


@query(f"""WITH {_LINE_COSINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, i) AS rank FROM cos)
SELECT doc_id, i, distance, rank FROM k WHERE rank <= 3""")
def J10_document_distractors(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("doc_id").orderBy("distance", "i")
    return _line_cosines(spark, d).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")


@query(f"""WITH {sql.SCORES}, {_GOLD}, f AS (SELECT s.* FROM scores s ANTI JOIN gold g ON s.qid = g.qid AND s.doc_id = g.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT qid, doc_id, score, rank FROM k WHERE rank <= 2""")
def J11_corpus_distractors(spark: SparkSession, d: str) -> DataFrame:
    left = R.excluding(_scores(spark, d), _gold(spark, d), ["qid", "doc_id"])
    return tfidf.top_k(left, 2).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_LINE_COSINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, i) AS rank FROM cos)
SELECT doc_id, i AS aligned, distance FROM k WHERE rank = 1""")
def J12_align_paragraph(spark: SparkSession, d: str) -> DataFrame:
    best = _line_cosines(spark, d).groupBy("doc_id").agg(F.min(F.struct("distance", "i")).alias("b"))
    return best.select("doc_id", F.col("b.i").alias("aligned"), F.col("b.distance").alias("distance"))


@query(f"""WITH {sql.SCORES} SELECT qid, string_agg(doc_id::varchar, ',' ORDER BY rank) AS top_titles, CAST(sum(n_chars) AS BIGINT) AS chars
FROM ranked JOIN documents USING (doc_id) WHERE rank <= {K} GROUP BY qid""")
def J13_open_top_titles(spark: SparkSession, d: str) -> DataFrame:
    top = tfidf.top_k(_scores(spark, d), K).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    return top.groupBy("qid").agg(F.array_join(ordered, ",").alias("top_titles"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {sql.SCORES} SELECT qid, doc_id, rank, md5(coalesce(text, '')) AS text FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5""")
def J14_open_top_texts(spark: SparkSession, d: str) -> DataFrame:
    top = tfidf.top_k(_scores(spark, d), 5).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return top.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))


_QUESTION_IDF = """qidf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM qp GROUP BY term)"""


@query(f"""WITH {sql.SCORES}, {_QUESTION_IDF}, {_LINES}, top AS (SELECT qid, doc_id FROM ranked WHERE rank <= 3),
wanted AS (SELECT * FROM lines WHERE doc_id IN (SELECT doc_id FROM top)),
lp AS ({sql.postings('wanted', 'doc_id, i')}), lu AS {_unit('lp', 'doc_id, i', 'qidf')}, qu AS {_unit('qp', 'qid', 'qidf')},
c AS (SELECT qu.qid, lu.doc_id, lu.i, round(1 - sum(qu.weight * lu.weight), 6) + 0.0 AS distance FROM lu JOIN top ON top.doc_id = lu.doc_id
  JOIN qu ON qu.qid = top.qid AND qu.term = lu.term GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id, i) AS place FROM c)
SELECT qid, doc_id, i, distance, place FROM k WHERE place <= {K}""")
def J15_paragraphs_of_top_titles(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the three best documents of each question, by cosine with idf of the questions."""
    asked = tfidf.postings(_questions(spark, d), "qid")
    rated = tfidf.smooth_idf(asked, tfidf.count_documents(table(spark, d, "benchmark")))
    top = tfidf.top_k(_scores(spark, d), 3).select("qid", "doc_id")
    wanted = _lines(spark, d).join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = tfidf.unit_vectors(tfidf.postings(wanted, LINE), LINE, rated)
    own = lines.join(top, "doc_id").withColumnRenamed("weight", "lw")
    met = own.join(tfidf.unit_vectors(asked, "qid", rated), ["qid", "term"])
    scored = met.groupBy("qid", *LINE).agg((F.round(1 - F.sum(F.col("lw") * F.col("weight")), 6) + 0.0).alias("distance"))
    order = W.partitionBy("qid").orderBy("distance", *LINE)
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= K)


@query(f"""WITH {_LINES}, lp AS ({sql.postings('lines', 'doc_id, i')}), qp AS ({sql.postings("(SELECT item_id AS qid, text FROM benchmark)", "qid")}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM lines)) / (1 + count(*))) + 1 AS idf FROM lp GROUP BY term),
lu AS {_unit('lp', 'doc_id, i', 'idf')}, qu AS {_unit('qp', 'qid', 'idf')},
c AS (SELECT qid, doc_id, i, round(1 - sum(qu.weight * lu.weight), 6) + 0.0 AS distance FROM qu JOIN lu USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id, i) AS rank FROM c)
SELECT qid, doc_id, i, distance, rank FROM k WHERE rank <= {K}""")
def J16_global_paragraph_rank(spark: SparkSession, d: str) -> DataFrame:
    scored = term_blocks.nearest_lines(_questions(spark, d), table(spark, d, "documents"), K)
    order = W.partitionBy("qid").orderBy("distance", *LINE)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= K)


@query(f"WITH {sql.SCORES} SELECT qid, doc_id, rank - 1 AS position FROM ranked")
def J17_rank_positions(spark: SparkSession, d: str) -> DataFrame:
    """The 0-based rank of every candidate, none cut."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return _scores(spark, d).select("qid", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("position"))


@query("SELECT a.l_orderkey, a.l_linenumber AS \"first\", b.l_linenumber AS \"second\" FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a "
       "JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def J27_unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return R.unordered_pairs(items, "l_orderkey", "l_linenumber")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS gold FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_linenumber AS "first", b.l_linenumber AS "second", a.gold::int AS first_label,
  (a.gold AND b.gold AND a.l_linenumber <> b.l_linenumber)::int AS second_label FROM i a JOIN i b USING (l_orderkey)""")
def J28_ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("g"))
    return R.ordered_pairs(items, "l_orderkey", "l_linenumber", F.col("g"))


@query(f"""WITH {sql.SCORES}, {_GOLD}, d AS (SELECT qid, doc_id FROM ranked ANTI JOIN gold USING (qid, doc_id) WHERE rank <= {K})
SELECT qid, doc_id, 1 AS label FROM gold UNION ALL SELECT qid, doc_id, 0 AS label FROM d""")
def J29_question_samples(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    distractors = R.excluding(tfidf.top_k(_scores(spark, d), K), gold, ["qid", "doc_id"]).select("qid", "doc_id")
    return gold.select("qid", "doc_id", F.lit(1).alias("label")).unionByName(distractors.withColumn("label", F.lit(0)))


@query("""WITH m AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN m USING (l_orderkey) WHERE l_linenumber <= m GROUP BY ALL""")
def J30_up_to_last_gold(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    last = lines.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    return lines.join(last, "l_orderkey").where("l_linenumber <= m").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_suppkey, string_agg(l_linenumber::varchar, ',' ORDER BY l_linenumber) AS sentences FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem
WHERE l_returnflag = 'R') GROUP BY ALL""")
def J31_supporting_by_title(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey")
    numbers = F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda n: n.cast("string"))
    return facts.agg(F.array_join(numbers, ",").alias("sentences"))


@query(f"""WITH {sql.SCORES}, {_GOLD}, g AS (SELECT gold.qid, gold.doc_id, coalesce(score, 0) AS score FROM gold LEFT JOIN scores USING (qid, doc_id))
SELECT qid, arg_max(doc_id, (score, -doc_id)) AS best, count(*) AS n_gold FROM g GROUP BY qid""")
def J34_best_gold(spark: SparkSession, d: str) -> DataFrame:
    """The gold document with the best score, which becomes the suffix of a second query."""
    met = _gold(spark, d).join(_scores(spark, d), ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return met.groupBy("qid").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("best"), F.count("*").alias("n_gold"))


@query("""SELECT doc_id, 0 AS added FROM labels UNION ALL SELECT doc_id, 1 AS added FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def J35_add_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id")
    new = table(spark, d, "documents").where("n_chars > 500").select("doc_id").join(known, "doc_id", "left_anti")
    return known.withColumn("added", F.lit(0)).unionByName(new.withColumn("added", F.lit(1)))


@query(f"WITH dp AS ({sql.postings('documents', 'doc_id')}) SELECT df, count(*) AS n_terms FROM (SELECT term, count(*) AS df FROM dp GROUP BY term) GROUP BY df")
def A01_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.document_frequency(_index(spark, d)).groupBy("df").agg(F.count("*").alias("n_terms"))


_WEIGHTS = f"""dp AS ({sql.postings('documents', 'doc_id')}),
idf AS (SELECT term, greatest(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 0) AS idf FROM (SELECT term, count(*) AS df FROM dp GROUP BY term)),
w AS (SELECT doc_id, term, ln(1 + tf) * idf AS weight FROM dp JOIN idf USING (term))"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return tfidf.weighted(index, tfidf.document_frequency(index), tfidf.count_documents(table(spark, d, "documents")))


@query(f"WITH {_WEIGHTS} SELECT doc_id, count(*) FILTER (WHERE weight > 0) AS n, round(sum(weight), 4) AS total FROM w GROUP BY doc_id")
def A02_tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).groupBy("doc_id").agg(F.count(F.when(F.col("weight") > 0, 1)).alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"""WITH {sql.SCORES} SELECT qid, term, round(ln(1 + tf) * idf, 6) AS weight FROM qp JOIN idf USING (term)""")
def A03_query_weights(spark: SparkSession, d: str) -> DataFrame:
    asked = tfidf.postings(_questions(spark, d), "qid")
    held = _index(spark, d).join(asked.select("term").distinct(), "term", "left_semi")
    rated = tfidf.weighted(asked, tfidf.document_frequency(held), tfidf.count_documents(table(spark, d, "documents")))
    return rated.select("qid", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH qp AS ({sql.postings("(SELECT item_id AS qid, text FROM benchmark)", "qid")}), {_QUESTION_IDF}, qu AS {_unit('qp', 'qid', 'qidf')}
SELECT a.qid AS left_qid, b.qid AS right_qid, round(1 - sum(a.weight * b.weight), 6) + 0.0 AS distance FROM qu a JOIN qu b USING (term) WHERE a.qid < b.qid GROUP BY ALL""")
def A04_smooth_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distances between the questions that share a term: a small, given query set."""
    asked = tfidf.postings(_questions(spark, d), "qid")
    unit = tfidf.unit_vectors(asked, "qid", tfidf.smooth_idf(asked, tfidf.count_documents(table(spark, d, "benchmark"))))
    left, right = unit.withColumnRenamed("qid", "left_qid"), unit.withColumnRenamed("qid", "right_qid")
    return tfidf.cosine_distance(left, right, "left_qid", "right_qid").where("left_qid < right_qid")


@query(f"WITH {_WEIGHTS}, u AS (SELECT doc_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS u FROM w WHERE weight > 0) "
       "SELECT doc_id, round(sum(u), 4) AS total, round(sum(u * u), 6) AS length FROM u GROUP BY doc_id")
def V11_normalize_sparse(spark: SparkSession, d: str) -> DataFrame:
    own = _weights(spark, d).where("weight > 0")
    norms = own.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = own.join(norms, "doc_id").withColumn("u", F.col("weight") / F.col("norm"))
    return unit.groupBy("doc_id").agg(F.round(F.sum("u"), 4).alias("total"), F.round(F.sum(F.col("u") * F.col("u")), 6).alias("length"))


@query(f"WITH {sql.SCORES} SELECT qid, doc_id, score FROM ranked WHERE rank <= 3")
def L01_partial_top_k(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_k(_scores(spark, d), 3).select("qid", "doc_id", "score")


@query(f"""WITH {sql.SCORES}, {_GOLD}, t AS (SELECT qid, doc_id, rank FROM ranked WHERE rank <= {K}),
h AS (SELECT g.qid, count(*) AS n, count(t.doc_id) AS hit FROM gold g LEFT JOIN t ON t.qid = g.qid AND t.doc_id = g.doc_id GROUP BY g.qid),
c AS (SELECT h.*, length(text) > 200 AS long FROM h JOIN benchmark ON item_id = qid)
SELECT long, count(*) AS n_questions, round(sum(hit) / sum(n), 6) AS hits, round(avg((hit = n)::int), 6) AS perfect, round(avg((hit > 0)::int), 6) AS at_least_one
FROM c GROUP BY GROUPING SETS ((), (long))""")
def A15_coverage_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Hits is a mean over gold documents, the others over questions; overall and by question length."""
    top = tfidf.top_k(_scores(spark, d), K).select("qid", "doc_id", F.lit(1).alias("hit"))
    per = _gold(spark, d).join(top, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), (F.length("text") > 200).alias("long"))
    mean = lambda c: F.round(F.avg(c.cast("int")), 6)
    return per.join(asked, "qid").groupingSets([[], ["long"]], "long").agg(
        F.count("*").alias("n_questions"), F.round(F.sum("hit") / F.sum("n"), 6).alias("hits"),
        mean(F.col("hit") == F.col("n")).alias("perfect"), mean(F.col("hit") > 0).alias("at_least_one"),
    )


_MODIFIED = f"""{sql.SCORES}, {_GOLD}, gs AS (SELECT gold.qid, gold.doc_id, coalesce(score, 0) AS score FROM gold LEFT JOIN scores USING (qid, doc_id)),
best AS (SELECT qid, arg_max(doc_id, (score, -doc_id)) AS best FROM gs GROUP BY qid),
others AS (SELECT gold.qid, gold.doc_id FROM gold JOIN best USING (qid) WHERE gold.doc_id <> best),
mq AS (SELECT best.qid, b.text || ' ' || d.text AS text FROM best JOIN benchmark b ON b.item_id = best.qid JOIN documents d ON d.doc_id = best),
mp AS ({sql.postings("mq", "qid")}),
ms AS (SELECT qid, doc_id, round(sum(ln(1 + mp.tf) * idf * ln(1 + dp.tf) * idf), 6) AS score FROM mp JOIN idf USING (term) JOIN dp USING (term) WHERE idf > 0 GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ms)"""


@query(f"""WITH {_MODIFIED} SELECT o.qid, o.doc_id, coalesce(a.rank <= {K}, false) AS plain_hit, coalesce(b.rank <= {K}, false) AS modified_hit
FROM others o LEFT JOIN ranked a ON a.qid = o.qid AND a.doc_id = o.doc_id LEFT JOIN mr b ON b.qid = o.qid AND b.doc_id = o.doc_id""")
def A16_second_gold_hit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the other gold documents are found by the question alone, and by it with the best gold's text."""
    docs, gold = table(spark, d, "documents"), _gold(spark, d)
    index = term_blocks.Index(docs, by_line=False)
    # Both uses of the plain search read what was dealt out by question, so it isn't run twice.
    plain = term_blocks.best_texts(_questions(spark, d), index, K, gold).repartition("qid")
    rated = gold.join(plain.where("wanted").drop("wanted"), ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = rated.groupBy("qid").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("best"))
    others = gold.join(best, "qid").where("doc_id <> best").select("qid", "doc_id")
    texts = docs.select(F.col("doc_id").alias("best"), F.col("text").alias("more"))
    modified = _questions(spark, d).join(best, "qid").join(texts, "best").select("qid", F.concat_ws(" ", "text", "more").alias("text"))
    hit = lambda s, name: tfidf.top_k(s.where("not wanted"), K).select("qid", "doc_id", F.lit(True).alias(name))
    parts = 1 + _questions(spark, d).count() * index.blocks // max(1, index.n)  # a question takes on the text of a document
    later = term_blocks.best_texts(modified, index, K, parts=parts)
    met = others.join(hit(plain, "plain_hit"), ["qid", "doc_id"], "left").join(hit(later, "modified_hit"), ["qid", "doc_id"], "left")
    return met.na.fill(False, ["plain_hit", "modified_hit"])
