"""Windows, sorts and set operations; events are ranked candidates of a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import sampling
from ..registry import query, table
from . import sql

_E = "e AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rank, event_id % 11 AS target FROM events)"


def _upto():
    """A user's candidates up to this one."""
    return W.partitionBy("user_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("rank", F.row_number().over(order).cast("long")).withColumn("target", F.col("event_id") % 11)


def expanding_pick(score: Column, rank: Column, target: Column) -> Column:
    """The target of the best candidate so far, the first of equals."""
    return F.max(F.struct(score.alias("s"), (-rank).alias("r"), target.alias("t"))).over(_upto())["t"]


@query(f"""WITH {_E} SELECT user_id, rank, arg_max(target, (value, -rank)) OVER (PARTITION BY user_id ORDER BY rank) AS used FROM e""")
def W01_expanding_argmax(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _ranked(spark, d).select("user_id", "rank", expanding_pick(c("value"), c("rank"), c("target")).alias("used"))


@query(f"WITH {_E} SELECT user_id, rank, max(value) OVER (PARTITION BY user_id ORDER BY rank) AS best FROM e")
def W02_cumulative_max(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("user_id", "rank", F.max("value").over(_upto()).alias("best"))


_W03 = f"""{_E}, w AS (SELECT user_id, rank, max(event_id % 13) OVER o AS span_q, max(event_id % 12) OVER o AS yn_q,
  arg_max(target, (value, -rank)) OVER o AS span_t, arg_max(target, (event_id % 17, -rank)) OVER o AS yn_t FROM e WINDOW o AS (PARTITION BY user_id ORDER BY rank)),
f AS (SELECT user_id, rank, CASE WHEN span_q >= yn_q THEN span_t ELSE yn_t END AS final FROM w)"""


def _yes_no(spark: SparkSession, d: str) -> DataFrame:
    """Expanding choice between a span and a yes/no branch; ties go to the span."""
    c = F.col
    e = _ranked(spark, d)
    span_q, yn_q = F.max(c("event_id") % 13).over(_upto()), F.max(c("event_id") % 12).over(_upto())
    span_t = expanding_pick(c("value"), c("rank"), c("target"))
    yn_t = expanding_pick(c("event_id") % 17, c("rank"), c("target"))
    return e.select("user_id", "rank", span_q.alias("sq"), yn_q.alias("yq"), span_t.alias("st"), yn_t.alias("yt")).select(
        "user_id", "rank", F.when(c("sq") >= c("yq"), c("st")).otherwise(c("yt")).alias("final")
    )


@query(f"WITH {_W03} SELECT * FROM f")
def W03_expanding_yes_no(spark: SparkSession, d: str) -> DataFrame:
    return _yes_no(spark, d)


@query(f"""WITH {_W03}, m AS (SELECT max(rank) AS m FROM f), g AS (SELECT user_id, unnest(range(1, (SELECT m FROM m) + 1)) AS rank FROM (SELECT DISTINCT user_id FROM f)),
p AS (SELECT g.user_id, g.rank, last_value(final IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.rank) AS v FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.rank = g.rank)
SELECT rank, round(avg(v), 6) AS mean FROM p GROUP BY rank""")
def W04_padded_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean at each rank; a series that has ended counts with its last value.

    Each series adds its steps where they happen and stays at its last value, so the
    means come from sums of steps by rank: one row a rank, however many series there are.
    """
    series = _yes_no(spark, d)
    before = F.lag("final", 1, 0).over(W.partitionBy("user_id").orderBy("rank"))
    steps = series.withColumn("step", F.col("final") - before).groupBy("rank").agg(F.sum("step").alias("step"))
    n = series.agg(F.countDistinct("user_id").alias("n"))
    total = F.sum("step").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return steps.join(F.broadcast(n)).select("rank", F.round(total / F.col("n"), 6).alias("mean"))


@query(f"WITH {_W03} SELECT user_id, arg_max(final, rank) AS answer FROM f GROUP BY user_id")
def W05_final_pick(spark: SparkSession, d: str) -> DataFrame:
    """The last state, by plain group maxima: no window is needed for it."""
    c = F.col
    pick = lambda s: F.max(F.struct(s.alias("s"), (-c("rank")).alias("r"), c("target").alias("t")))["t"]
    best = _ranked(spark, d).groupBy("user_id").agg(
        F.max(c("event_id") % 13).alias("sq"), F.max(c("event_id") % 12).alias("yq"), pick(c("value")).alias("st"), pick(c("event_id") % 17).alias("yt")
    )
    return best.select("user_id", F.when(c("sq") >= c("yq"), c("st")).otherwise(c("yt")).alias("answer"))


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS place FROM e) SELECT user_id, event_id, place FROM r WHERE event_type = 'purchase'")
def W07_rank_of_gold(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) - 1
    return table(spark, d, "events").withColumn("place", place.cast("long")).where("event_type = 'purchase'").select("user_id", "event_id", "place")


@query("""SELECT doc_id, i, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars
FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, length(unnest(l)) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""")
def W08_running_offsets(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "t"))
    before = W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))
    return parts.select("doc_id", (F.col("at") + 1).cast("long").alias("i"), offset.cast("long").alias("offset_chars"))


@query("""WITH c AS (SELECT user_id, event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT user_id, event_id FROM c WHERE before < 500""")
def W10_running_budget(spark: SparkSession, d: str) -> DataFrame:
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("value").over(before), F.lit(0.0))
    return table(spark, d, "events").withColumn("before", spent).where("before < 500").select("user_id", "event_id")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS batch FROM events")
def W11_batch_number(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("user_id", "event_id", F.floor((F.col("rank") - 1) / 8).alias("batch"))


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def L02_ordered_prefix(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    return table(spark, d, "events").withColumn("rank", rank).where("rank <= 5").select("user_id", "event_id", "rank")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events), f AS (SELECT user_id, event_type, min(r) AS r FROM r WHERE r <= 12 GROUP BY ALL)
SELECT user_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS rank FROM f) WHERE rank <= 3""")
def L03_oversample_dedupe_cut(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieval import first_seen

    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    cut = table(spark, d, "events").withColumn("rank", rank).where("rank <= 12")
    return first_seen(cut, ["user_id"], ["event_type"], 3).select("user_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_E} SELECT user_id, event_id FROM e WHERE rank <= 4")
def L04_list_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).where("rank <= 4").select("user_id", "event_id")


@query(f"SELECT w, uses, row_number() OVER (ORDER BY uses DESC, w) AS place FROM (SELECT w, count(*) AS uses FROM ({sql.positions('documents', 'doc_id')}) GROUP BY w)")
def L05_most_common(spark: SparkSession, d: str) -> DataFrame:
    """All words with their place in the order of their uses, the most frequent first."""
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t")).groupBy(F.lower("t").alias("w"))
    placed = sampling.numbered(words.agg(F.count("*").alias("uses")), [F.desc("uses"), F.col("w")])
    return placed.select("w", "uses", (F.col("n") + 1).cast("long").alias("place"))


@query(f"WITH {_E} SELECT user_id, string_agg(event_id::varchar, ',' ORDER BY rank) AS ids FROM e GROUP BY user_id")
def L07_sorted_lists(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string"))
    return _ranked(spark, d).groupBy("user_id").agg(F.array_join(ids, ",").alias("ids"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20")
def L08_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(20)


@query("SELECT p_brand AS name FROM part UNION ALL SELECT c_mktsegment AS name FROM customer")
def U01_bag_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("name")).unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")))


@query(f"SELECT lower(unnest({sql.tokens('p_name')})) AS w FROM part UNION SELECT lower(unnest({sql.tokens('p_type')})) AS w FROM part")
def U02_vocabulary_union(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: table(spark, d, "part").select(F.explode(F.transform(T.tokens(F.col(c)), F.lower)).alias("w"))
    return of("p_name").union(of("p_type")).distinct()


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 25)
SELECT 'tp' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'fp', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'fn', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def U03_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """All three counts from one pass: a key's sides are two flags."""
    line = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_quantity") > 25).alias("b"))
    count = lambda c: F.count(F.when(c, 1))
    one = line.agg(count(F.col("a") & F.col("b")).alias("tp"), count(F.col("a") & ~F.col("b")).alias("fp"), count(~F.col("a") & F.col("b")).alias("fn"))
    return one.selectExpr("stack(3, 'tp', tp, 'fp', fp, 'fn', fn) as (kind, n)")


@query("""SELECT l_partkey, CAST(least(sum((l_returnflag = 'R')::int), sum((l_quantity > 25)::int)) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey HAVING n > 0""")
def U04_multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    both = F.least(count(F.col("l_returnflag") == "R"), count(F.col("l_quantity") > 25))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(both.alias("n")).where("n > 0")


@query("SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey)) AS part FROM lineitem GROUP BY ALL")
def U05_add_unless_known(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key stays."""
    first = F.min_by("l_partkey", F.struct("l_shipdate", "l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first.alias("part"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def U06_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT DISTINCT source, lang FROM documents")
def U07_distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT 0 AS hop, vec_id FROM embeddings WHERE label < 3 UNION ALL SELECT 1 AS hop, vec_id FROM embeddings WHERE label >= 7")
def U08_hop_concatenation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.where("label < 3").select(F.lit(0).alias("hop"), "vec_id").unionByName(e.where("label >= 7").select(F.lit(1).alias("hop"), "vec_id"))
