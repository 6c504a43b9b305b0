"""Metrics: answers from conversations, rankings from events, labels from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import metrics as M
from ..registry import query, table
from . import sql

SIX = lambda c: F.round(c, 6)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn as a prediction of the conversation's next one; the last has no gold."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"), after.alias("gold"))
    return turns.where("gold is not null")


_ANSWERS = f"""
turns AS (SELECT conv_id, turn, text AS prediction, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations WHERE role = 'assistant'),
norm AS (SELECT conv_id, turn, {sql.normalized('prediction')} AS p, {sql.normalized('gold')} AS g FROM turns WHERE gold IS NOT NULL),
arr AS (SELECT *, list_filter(string_split(p, ' '), lambda t: t <> '') AS pt, list_filter(string_split(g, ' '), lambda t: t <> '') AS gt FROM norm),
tok AS (SELECT conv_id, turn, unnest(pt) AS t, 1 AS a, 0 AS b FROM arr UNION ALL SELECT conv_id, turn, unnest(gt) AS t, 0 AS a, 1 AS b FROM arr),
sh AS (SELECT conv_id, turn, sum(least(x, y)) AS n FROM (SELECT conv_id, turn, t, sum(a) AS x, sum(b) AS y FROM tok GROUP BY ALL) GROUP BY ALL),
ns AS (SELECT conv_id, turn, p = g AS same, len(pt) AS np, len(gt) AS ng,
  CASE WHEN p <> g AND (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) THEN 0 ELSE coalesce(n, 0) END AS n FROM arr LEFT JOIN sh USING (conv_id, turn)),
ans AS (SELECT conv_id, turn, same::int AS em, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE n / np END AS prec, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE n / ng END AS recall FROM ns),
a AS (SELECT *, CASE WHEN prec + recall = 0 THEN 0.0::DOUBLE ELSE 2 * prec * recall / (prec + recall) END AS f1 FROM ans)"""


def _answer_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.answer_scores(_answers(spark, d), ["conv_id", "turn"], "prediction", "gold")


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, em, round(f1, 6) AS f1, round(prec, 6) AS prec, round(recall, 6) AS recall FROM a")
def A11_answer_f1(spark: SparkSession, d: str) -> DataFrame:
    return _answer_scores(spark, d).select("conv_id", "turn", "em", SIX("f1").alias("f1"), SIX("prec").alias("prec"), SIX("recall").alias("recall"))


@query(f"WITH {_ANSWERS} SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(prec), 6) AS prec, round(avg(recall), 6) AS recall FROM a")
def A12_answer_means(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: SIX(F.avg(c)).alias(c)
    return _answer_scores(spark, d).agg(F.count("*").alias("n"), *map(mean, ("em", "f1", "prec", "recall")))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Supporting facts of orders: predicted ones are returned lines, gold ones those of a large quantity."""
    fact = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", fact)).alias("p"), F.collect_set(F.when(F.col("l_quantity") > 25, fact)).alias("g")
    )
    return lines.select("l_orderkey", M.set_scores(F.col("p"), F.col("g")).alias("s")).select("l_orderkey", "s.*")


_FACTS = """
x AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS p, bool_or(l_quantity > 25) AS g FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey, sum((p AND g)::int) AS tp, sum(p::int) AS np, sum(g::int) AS ng FROM x GROUP BY ALL),
pr AS (SELECT l_orderkey, (tp = np AND tp = ng)::int AS em, CASE WHEN np > 0 THEN tp / np ELSE 0.0::DOUBLE END AS prec, CASE WHEN ng > 0 THEN tp / ng ELSE 0.0::DOUBLE END AS recall FROM c),
sp AS (SELECT *, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0::DOUBLE END AS f1 FROM pr)"""


@query(f"WITH {_FACTS} SELECT l_orderkey, em, round(f1, 6) AS f1, round(prec, 6) AS prec, round(recall, 6) AS recall FROM sp")
def A13_supporting_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("l_orderkey", "em", *[SIX(c).alias(c) for c in ("f1", "prec", "recall")])


_JOINT = f"""{_ANSWERS}, {_FACTS},
j AS (SELECT a.em AS em, a.f1 AS f1, a.prec AS prec, a.recall AS recall, coalesce(sp.em, 0) AS sp_em, coalesce(sp.f1, 0) AS sp_f1, coalesce(sp.prec, 0) AS sp_prec,
  coalesce(sp.recall, 0) AS sp_recall FROM a LEFT JOIN sp ON l_orderkey = conv_id * 10 + turn),
k AS (SELECT *, prec * sp_prec AS jp, recall * sp_recall AS jr, em * sp_em AS jem FROM j)"""


@query(f"""WITH {_JOINT} SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(sp_em), 6) AS sp_em, round(avg(sp_f1), 6) AS sp_f1,
round(avg(jem), 6) AS joint_em, round(avg(CASE WHEN jp + jr > 0 THEN 2 * jp * jr / (jp + jr) ELSE 0 END), 6) AS joint_f1, round(avg(jp), 6) AS joint_prec, round(avg(jr), 6) AS joint_recall FROM k""")
def A14_joint_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the facts of the order conv_id * 10 + turn; a missing order counts 0 and still divides."""
    facts = _facts(spark, d).select("l_orderkey", *[F.col(c).alias(f"sp_{c}") for c in ("em", "f1", "prec", "recall")])
    met = _answer_scores(spark, d).join(facts, F.col("l_orderkey") == F.col("conv_id") * 10 + F.col("turn"), "left").na.fill(0)
    p, r = F.col("prec") * F.col("sp_prec"), F.col("recall") * F.col("sp_recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    mean = lambda c, name: SIX(F.avg(c)).alias(name)
    return met.agg(
        F.count("*").alias("n"), *[mean(c, c) for c in ("em", "f1", "sp_em", "sp_f1")], mean(F.col("em") * F.col("sp_em"), "joint_em"),
        mean(f1, "joint_f1"), mean(p, "joint_prec"), mean(r, "joint_recall"),
    )


@query(f"""WITH {_ANSWERS}, g AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT count(*) AS n, round(sum(coalesce(em, 0)) / count(*), 6) AS em, round(sum(coalesce(f1, 0)) / count(*), 6) AS f1 FROM g LEFT JOIN a USING (conv_id, turn)""")
def J33_missing_predictions(spark: SparkSession, d: str) -> DataFrame:
    """All assistant turns count; those without a score add 0."""
    gold = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    met = gold.join(_answer_scores(spark, d), ["conv_id", "turn"], "left")
    part = lambda c: SIX(F.sum(F.coalesce(c, F.lit(0.0))) / F.count("*")).alias(c)
    return met.agg(F.count("*").alias("n"), part("em"), part("f1"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates of a user, best value first; purchases are positive."""
    order = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    own = table(spark, d, "events").withColumn("positive", F.col("event_type") == "purchase")
    return own.withColumn("rank", F.row_number().over(order))


_RANKED = "r AS (SELECT *, event_type = 'purchase' AS positive, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"


@query(f"""WITH {_RANKED}, p AS (SELECT user_id, max(rank) AS rank FROM r WHERE positive GROUP BY user_id)
SELECT count(*) AS n, round(avg((rank = 1)::int), 6) AS p_at_1, round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr FROM p""")
def A18_last_positive_rank(spark: SparkSession, d: str) -> DataFrame:
    """With several positives the last one's rank counts."""
    last = _ranked(spark, d).where("positive").groupBy("user_id").agg(F.max("rank").alias("rank"))
    return last.agg(
        F.count("*").alias("n"), SIX(F.avg((F.col("rank") == 1).cast("int"))).alias("p_at_1"), SIX(F.avg("rank")).alias("mean_rank"),
        SIX(F.avg(1 / F.col("rank"))).alias("mrr"),
    )


@query(f"""WITH {_RANKED}, p AS (SELECT user_id, min(rank) AS best, avg(rank) AS mean FROM r WHERE positive GROUP BY user_id)
SELECT count(*) AS n, round(avg((best = 1)::int), 6) AS p_at_1, round(avg(mean), 6) AS mean_rank, round(avg(1 / best), 6) AS mrr FROM p""")
def A19_multi_positive_rank(spark: SparkSession, d: str) -> DataFrame:
    per = _ranked(spark, d).where("positive").groupBy("user_id").agg(F.min("rank").alias("best"), F.avg("rank").alias("mean"))
    return per.agg(
        F.count("*").alias("n"), SIX(F.avg((F.col("best") == 1).cast("int"))).alias("p_at_1"), SIX(F.avg("mean")).alias("mean_rank"),
        SIX(F.avg(1 / F.col("best"))).alias("mrr"),
    )


_COUNTS = "count(*) AS n, CAST(sum((label AND pred)::int) AS BIGINT) AS tp, CAST(sum((NOT label AND pred)::int) AS BIGINT) AS fp, CAST(sum((label AND NOT pred)::int) AS BIGINT) AS fn"
_RATES = """n, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy"""
_LABELLED = "l AS (SELECT quality = 1 AS label, n_chars > 500 AS pred, n_chars AS score, lang FROM documents JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Document length as a score of quality."""
    met = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("score")).join(table(spark, d, "labels"), "doc_id")
    return met.select("lang", "score", (F.col("quality") == 1).alias("label"))


@query(f"""WITH {_LABELLED}, c AS (SELECT {_COUNTS} FROM l),
t AS (SELECT score, sum(label::int) AS pos, sum((NOT label)::int) AS neg FROM l GROUP BY score),
u AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS sp, sum(neg) OVER (ORDER BY score DESC) AS sn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM t),
m AS (SELECT round(sum(neg * (sp - pos) + pos * neg / 2) / (max(ap) * max(an)), 6) AS auc, round(sum(pos / ap * sp / (sp + sn)), 6) AS average_precision FROM u)
SELECT {_RATES}, auc, average_precision FROM c, m""")
def A20_binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    counts = M.binary_counts(rows, F.col("label"), F.col("score") > 500)
    curve = M.auc_and_precision(rows, "score", F.col("label"))
    return counts.join(F.broadcast(curve))  # one row each


@query(f"WITH {_LABELLED}, c AS (SELECT lang, {_COUNTS} FROM l GROUP BY lang) SELECT lang, {_RATES} FROM c")
def A21_metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    return M.binary_counts(_labelled(spark, d), F.col("label"), F.col("score") > 500, ["lang"])


@query("SELECT event_type, round(avg(m), 6) AS mean FROM (SELECT event_type, user_id % 7 AS seed, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def A22_mean_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("seed")).agg(F.avg("value").alias("m"))
    return runs.groupBy("event_type").agg(SIX(F.avg("m")).alias("mean"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber % 5 AS s, l_linenumber % 5 + CAST(l_quantity AS INT) % 4 AS e FROM lineitem),
p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 6 AS a, CAST(floor(o_totalprice) AS BIGINT) % 6 + 2 AS b FROM orders),
o AS (SELECT o_orderkey, s, e, a, b, greatest(0, least(e, b) - greatest(s, a) + 1) AS n FROM p JOIN x ON l_orderkey = o_orderkey)
SELECT o_orderkey, max((s = a AND e = b)::int) AS exact, round(max(2 * n / ((e - s + 1) + (b - a + 1))), 6) AS f1 FROM o GROUP BY o_orderkey""")
def A23_span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best agreement of one predicted span with several gold ones."""
    from ..functions import spans as S

    gold = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber % 5 as s", "l_linenumber % 5 + cast(l_quantity as int) % 4 as e")
    found = table(spark, d, "orders").selectExpr("o_orderkey", "cast(o_totalprice as bigint) % 6 as a", "cast(o_totalprice as bigint) % 6 + 2 as b")
    met = found.join(gold, F.col("o_orderkey") == F.col("l_orderkey"))
    c = F.col
    exact = F.max(((c("s") == c("a")) & (c("e") == c("b"))).cast("int"))
    return met.groupBy("o_orderkey").agg(exact.alias("exact"), SIX(F.max(S.overlap_f1(c("s"), c("e"), c("a"), c("b")))).alias("f1"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id % 10 / 10 AS yn, (event_id % 7) / 10 AS nyn FROM events),
b AS (SELECT user_id, arg_max(event_type, (value, -ord)) AS picked, max(yn) AS yn, max(nyn) AS nyn FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN yn > nyn THEN 'yes/no' ELSE picked END AS answer FROM b""")
def A24_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The first best candidate of each question; a yes/no answer where the columns' maxima say so."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("ord", F.row_number().over(order))
    best = e.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("value", -F.col("ord"))).alias("picked"), F.max(F.col("event_id") % 10 / 10).alias("yn"),
        F.max(F.col("event_id") % 7 / 10).alias("nyn"),
    )
    return best.select("user_id", F.when(F.col("yn") > F.col("nyn"), "yes/no").otherwise(F.col("picked")).alias("answer"))


@query("""WITH e AS (SELECT user_id, event_id AS ord, value AS x, event_id % 5 AS y FROM events),
p AS (SELECT a.user_id, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x <> b.x AS dx, a.y <> b.y AS dy FROM e a JOIN e b ON a.user_id = b.user_id AND a.ord < b.ord)
SELECT user_id, round(sum(s) / sqrt(sum(dx::int)::DOUBLE * sum(dy::int)), 6) AS tau FROM p GROUP BY user_id HAVING sum(dx::int) > 0 AND sum(dy::int) > 0""")
def A25_kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id", "event_id as ord", "value as x", "event_id % 5 as y")
    return M.kendall_tau(e, "user_id", "x", "y")


@query(f"WITH {_RANKED} SELECT rank, count(*) AS n FROM (SELECT user_id, min(rank) AS rank FROM r WHERE positive GROUP BY user_id) GROUP BY rank")
def A26_hits_at_rank(spark: SparkSession, d: str) -> DataFrame:
    best = _ranked(spark, d).where("positive").groupBy("user_id").agg(F.min("rank").alias("rank"))
    return best.groupBy(F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ANSWERS}, s AS (SELECT conv_id, turn, coalesce(em, 0) AS em, f1, (turn % 3) / 2 AS yn, (conv_id % 3) / 2 AS nyn FROM a)
SELECT conv_id, turn, CASE WHEN nyn >= yn THEN 'span' WHEN turn % 2 >= conv_id % 2 THEN 'yes' ELSE 'no' END AS answer, em, round(f1, 6) AS f1 FROM s""")
def A27_candidate_record(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import spans as S

    c = F.col
    answer = S.answer_text(F.lit("span"), c("conv_id") % 3 / 2, c("turn") % 3 / 2, c("conv_id") % 2, c("turn") % 2)
    return _answer_scores(spark, d).select("conv_id", "turn", answer.alias("answer"), "em", SIX("f1").alias("f1"))


@query("SELECT round(avg(value), 6) AS loss, bool_or(isnan(value)) AS has_nan FROM events")
def A28_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(SIX(F.avg("value")).alias("loss"), F.bool_or(F.isnan("value")).alias("has_nan"))


@query(f"""WITH {_RANKED} SELECT w.user_id, w.event_id AS wrong, g.event_id AS gold, g.rank FROM r w JOIN
(SELECT user_id, arg_min(event_id, rank) AS event_id, min(rank) AS rank FROM r WHERE positive GROUP BY user_id) g ON w.user_id = g.user_id AND w.rank = 1 AND g.rank > 1""")
def A30_error_listing(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    gold = ranked.where("positive").groupBy("user_id").agg(F.min(F.struct("rank", "event_id")).alias("g")).where("g.rank > 1")
    wrong = ranked.where("rank = 1").select("user_id", F.col("event_id").alias("wrong"))
    return wrong.join(gold, "user_id").select("user_id", "wrong", F.col("g.event_id").alias("gold"), F.col("g.rank").cast("long").alias("rank"))


@query(f"SELECT w, count(*) AS n FROM ({sql.positions('documents', 'doc_id')}) GROUP BY w")
def A06_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.transform(T.tokens(F.col("text")), F.lower)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT unnest({sql.tokens('text')}) AS w FROM documents) SELECT DISTINCT w FROM t UNION SELECT DISTINCT lower(w) FROM t")
def A05_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with their lower-case forms."""
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    return words.select(F.explode(F.array("w", F.lower("w"))).alias("w")).distinct()


@query(f"""WITH t AS (SELECT w, count(*) AS n FROM (SELECT unnest({sql.tokens('text')}) AS w FROM documents) GROUP BY w),
c AS (SELECT unnest(string_split(w, '')) AS ch, n FROM t)
SELECT ch, CAST(sum(n) AS BIGINT) AS n FROM c WHERE ch <> '' GROUP BY ch HAVING sum(n) >= 100""")
def A07_char_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    chars = words.select(F.explode(F.split("w", "")).alias("ch"), "n").where("ch <> ''")
    return chars.groupBy("ch").agg(F.sum("n").alias("n")).where("n >= 100")


@query(f"""WITH t AS (SELECT lower(unnest({sql.tokens('text')})) AS w FROM documents), p AS (SELECT lower(unnest({sql.tokens('p_name')})) AS w FROM part)
SELECT w FROM t GROUP BY w HAVING count(*) >= 50 UNION SELECT w FROM p GROUP BY w HAVING count(*) >= 2 UNION SELECT unnest(['<S>', '</S>', '<UNK>'])""")
def A08_vocab_union(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, c: table(spark, d, t).select(F.explode(F.transform(T.tokens(F.col(c)), F.lower)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    special = spark.range(1).select(F.explode(F.array(*map(F.lit, ("<S>", "</S>", "<UNK>")))).alias("w"))
    return of("documents", "text").where("n >= 50").select("w").union(of("part", "p_name").where("n >= 2").select("w")).union(special).distinct()


@query("SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def A09_highest_gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))


@query(f"""SELECT max(len({sql.tokens('text')})) AS max_tokens, max(list_max(list_transform({sql.tokens('text')}, lambda w: length(w)))) AS max_word,
CASE WHEN count(*) = count(lang) THEN max(length(lang)) END AS max_lang FROM documents""")
def A10_shape_spec(spark: SparkSession, d: str) -> DataFrame:
    """Largest sizes; a null in a column makes its size unknown."""
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").agg(
        F.max(F.size(t)).cast("long").alias("max_tokens"), F.max(F.array_max(F.transform(t, F.length))).cast("long").alias("max_word"),
        F.when(F.count("*") == F.count("lang"), F.max(F.length("lang"))).cast("long").alias("max_lang"),
    )
