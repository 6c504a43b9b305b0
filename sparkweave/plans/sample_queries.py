"""Batches, samples and training pairs over events, orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import sampling as S
from ..registry import query, table

SEED = 18


def _draw(*key: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(f'{k}::varchar' for k in key)}))"



@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 32 AS batch FROM events")
def B01_fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = S.batches(table(spark, d, "events").select("ts", "event_id"), [F.col("ts"), F.col("event_id")], 32)
    return rows.select("event_id", "batch")


@query(f"SELECT event_id, (row_number() OVER (ORDER BY {_draw('event_id')}, event_id) - 1) // 32 AS batch FROM events")
def B02_shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffled_batches(table(spark, d, "events").select("event_id"), SEED, ["event_id"], 32)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 50 AS batch FROM orders")
def B03_clustered_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = S.clustered_batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, SEED)
    return rows.select("o_orderkey", "batch")


@query("SELECT event_id, batch FROM (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 32 AS batch FROM events) WHERE batch < 10")
def B04_first_batches(spark: SparkSession, d: str) -> DataFrame:
    """An iterator over the first ten batches: the batch number is the feature's limit."""
    return B01_fixed_batches(spark, d).where("batch < 10")


@query(f"SELECT o_orderkey FROM orders ORDER BY {_draw('o_orderkey')}, o_orderkey LIMIT 500")
def B05_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample(table(spark, d, "orders").select("o_orderkey"), SEED, ["o_orderkey"], 500)


_ITEMS = "i AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS gold FROM lineitem GROUP BY ALL)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("gold"))


_ENOUGH = f"WITH {_ITEMS}, e AS (SELECT l_orderkey FROM i GROUP BY l_orderkey HAVING sum(gold::int) >= 2 AND sum((NOT gold)::int) >= 2)"


@query(f"{_ENOUGH} SELECT l_orderkey, kind, CASE kind WHEN 'mixed' THEN 2 ELSE 1 END AS n FROM e, (VALUES ('gold'), ('mixed'), ('false')) AS k(kind)")
def B06_stratified_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each kind of pair; the draws themselves follow a hash."""
    pairs = S.pair_samples(_items(spark, d), "l_orderkey", "l_partkey", F.col("gold"), SEED)
    return pairs.groupBy("l_orderkey", "kind").agg(F.count("*").cast("int").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS n FROM g)
SELECT a.l_orderkey, a.l_partkey AS first_gold, b.l_partkey AS second_gold FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.n = 1 AND b.n = 2""")
def B07_gold_order(spark: SparkSession, d: str) -> DataFrame:
    """The gold item with the higher score comes first."""
    gold = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("score"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_partkey"))
    two = gold.withColumn("n", place).where("n <= 2").groupBy("l_orderkey")
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("l_partkey")))
    return two.agg(pick(1).alias("first_gold"), pick(2).alias("second_gold")).where("second_gold is not null")


@query(f"""WITH r AS (SELECT o_orderkey, unnest([1, 2, 3, 4]) AS draw FROM orders), u AS (SELECT *, {_draw('o_orderkey', 'draw')} AS u FROM r)
SELECT o_orderkey, draw, CASE WHEN u < '{S.below(0.35)}' THEN 'first_gold_second_false' WHEN u < '{S.below(0.6)}' THEN 'false1'
  WHEN u < '{S.below(0.35 + 0.25 + 0.35)}' THEN 'false2' ELSE 'false3' END AS kind FROM u""")
def B07_false_samples(spark: SparkSession, d: str) -> DataFrame:
    """Four false samples of an order by kind, drawn by fixed shares."""
    shares = [("first_gold_second_false", 0.35), ("false1", 0.25), ("false2", 0.35), ("false3", 0.05)]
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("draw"))
    return rows.withColumn("kind", S.choose(SEED, ["o_orderkey", "draw"], shares))


@query(f"""WITH {_ITEMS}, f AS (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_draw('l_orderkey', 'l_partkey')}, l_partkey) AS INT) AS ordinal
  FROM i WHERE NOT gold)
SELECT l_orderkey, l_partkey AS batch, l_partkey, 0 AS ordinal FROM i WHERE gold
UNION ALL SELECT i.l_orderkey, i.l_partkey AS batch, f.l_partkey, ordinal FROM i JOIN f USING (l_orderkey) WHERE gold AND ordinal <= 3""")
def B08_ranking_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each gold item followed by three distractors of its order; the gold item names the batch."""
    items = _items(spark, d)
    gold = items.where("gold").select("l_orderkey", F.col("l_partkey").alias("batch"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(S.draw(SEED, "l_orderkey", "l_partkey"), "l_partkey"))
    false = items.where("not gold").withColumn("ordinal", place).where("ordinal <= 3").select("l_orderkey", "l_partkey", "ordinal")
    own = gold.select("l_orderkey", "batch", F.col("batch").alias("l_partkey"), F.lit(0).alias("ordinal"))
    return own.unionByName(gold.join(false, "l_orderkey").select("l_orderkey", "batch", "l_partkey", "ordinal"))


@query(f"""WITH g AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS n FROM g),
p AS (SELECT a.l_orderkey, a.l_partkey AS x, b.l_partkey AS y, {_draw('a.l_orderkey')} < '8' AS turn FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.n = 1 AND b.n = 2)
SELECT l_orderkey, CASE WHEN turn THEN x ELSE y END AS "first", CASE WHEN turn THEN y ELSE x END AS "second" FROM p""")
def B09_gold_pair_order(spark: SparkSession, d: str) -> DataFrame:
    """Merged gold pairs in an order drawn by the hash."""
    pairs = B07_gold_order(spark, d)
    turn = S.draw(SEED, "l_orderkey") < S.below(0.5)
    a, b = F.col("first_gold"), F.col("second_gold")
    return pairs.select("l_orderkey", F.when(turn, a).otherwise(b).alias("first"), F.when(turn, b).otherwise(a).alias("second"))


@query(f"""WITH {_ITEMS}, c AS (SELECT l_orderkey, sum(gold::int) AS g, sum((NOT gold)::int) AS d FROM i GROUP BY l_orderkey)
SELECT l_orderkey, CAST(1 + least(3, d) AS BIGINT) AS n FROM c WHERE g > 0""")
def B10_one_gold_three_distractors(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    place = F.row_number().over(W.partitionBy("l_orderkey", "gold").orderBy(S.draw(SEED, "l_orderkey", "l_partkey"), "l_partkey"))
    chosen = items.withColumn("n", place).where((F.col("gold") & (F.col("n") == 1)) | (~F.col("gold") & (F.col("n") <= 3)))
    return chosen.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or("gold").alias("has")).where("has").select("l_orderkey", "n")


@query(f"""WITH c AS (SELECT doc_id, source, row_number() OVER (ORDER BY {_draw('doc_id')}, doc_id) - 1 AS n FROM documents WHERE n_chars >= 500),
a AS (SELECT item_id, 'src' || (item_id % 20) AS own, unnest(range(1, 9)) AS attempt FROM benchmark),
t AS (SELECT item_id, own, attempt, ('0x' || substr({_draw('item_id', 'attempt')}, 1, 13))::BIGINT % (SELECT count(*) FROM c) AS n FROM a),
m AS (SELECT item_id, own, source, doc_id, min(attempt) AS attempt FROM t JOIN c USING (n) WHERE source <> own GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY attempt) AS turn FROM m)
SELECT item_id, own, source, doc_id, turn FROM r WHERE turn <= 2""")
def B11_random_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """For each question, two long documents of other sources than its own (its id's), each drawn for it alone.

    A draw names a place among all long documents, numbered in the order of a hash;
    draws that meet the question's own source or a document drawn before are rejected.
    Eight draws are made, which is the operator's bound on tries.
    """
    docs = table(spark, d, "documents").where("n_chars >= 500").select("doc_id", "source")
    numbered = S.numbered(docs, [S.draw(SEED, "doc_id"), F.col("doc_id")])
    total = docs.agg(F.count("*").alias("total"))
    asked = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("own"))
    tries = asked.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(8)))).join(F.broadcast(total))  # one row is broadcast
    placed = tries.where("total > 0").withColumn("n", S.draw_number(SEED, "item_id", "attempt") % F.col("total"))
    met = placed.join(numbered, "n").where("source <> own").groupBy("item_id", "own", "source", "doc_id").agg(F.min("attempt").alias("attempt"))
    turn = F.row_number().over(W.partitionBy("item_id").orderBy("attempt")).cast("long")
    return met.withColumn("turn", turn).where("turn <= 2").select("item_id", "own", "source", "doc_id", "turn")


@query(f"""WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM i WHERE NOT gold),
b AS (SELECT l_orderkey, l_partkey FROM r WHERE n <= 3 UNION SELECT l_orderkey, max(l_partkey) FROM i WHERE NOT gold GROUP BY l_orderkey)
SELECT l_orderkey, count(*) AS n FROM b GROUP BY l_orderkey""")
def B14_distractor_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Distractors from two rules, each counted once."""
    false = _items(spark, d).where("not gold").select("l_orderkey", "l_partkey")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey"))
    own = false.withColumn("n", place).where("n <= 3").select("l_orderkey", "l_partkey")
    last = false.groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"))
    return own.union(last).distinct().groupBy("l_orderkey").agg(F.count("*").alias("n"))
