"""Stored splits and indexes, training data behind hooks, merged evaluations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import sampling, tfidf, training
from ..registry import query, table
from ..sources import corpora, readers, stores
from ..storage import own_folder
from . import sql
from .sample_queries import SEED


def _folder(spark: SparkSession) -> str:
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 = 0")
def S14_split_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as two splits; the dev part is read back."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    corpus = corpora.SplitCorpus(spark, _folder(spark))
    corpus.write("doc_id", train=docs.where("doc_id % 5 <> 0"), dev=docs.where("doc_id % 5 = 0"))
    return corpus.split("dev")


@query(f"""WITH qp AS ({sql.postings("(SELECT item_id AS qid, text FROM benchmark)", "qid")}) SELECT qid, term, tf, 2 AS n FROM qp""")
def S16_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the questions, written and read back with the length of their n-grams."""
    store = corpora.IndexStore(spark, _folder(spark))
    store.write(tfidf.postings(table(spark, d, "benchmark").withColumnRenamed("item_id", "qid"), "qid"), n=2)
    return store.postings().withColumn("n", F.lit(store.metadata()["n"]))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS n FROM l)
SELECT doc_id, min(n) AS first_id, max(n) AS last_id FROM n GROUP BY doc_id""")
def S18_encoding_index(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for encoded sentences: the ids of each document's lines in one matrix of all."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\n")).alias("sent_id", "t"))
    return corpora.encoding_index(lines.drop("t"), ["doc_id"], ["sent_id"])


@query("""SELECT o_orderkey::varchar AS qid, o_orderpriority AS answer, l_suppkey::varchar AS title, l_linenumber AS sent_id
FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey""")
def S22_prediction_file(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as one object of answers and one of facts, read back, a row for each fact."""
    fact = F.struct(F.col("l_suppkey").cast("string").alias("title"), F.col("l_linenumber").cast("int").alias("sent_id"))
    facts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set(fact).alias("sp"))
    met = table(spark, d, "orders").join(facts, F.col("o_orderkey") == F.col("l_orderkey"))
    path = _folder(spark)
    stores.write_predictions(met.select(F.col("o_orderkey").cast("string").alias("qid"), F.col("o_orderpriority").alias("answer"), "sp"), path)
    return readers.predictions(spark, path).select("qid", "answer", F.inline("sp"))


@query("SELECT doc_id, lower(trim(text)) AS sample FROM documents WHERE n_chars > 100 AND lang = 'en' AND length(trim(text)) > 0")
def P13_hooks(spark: SparkSession, d: str) -> DataFrame:
    """A filter and a preprocessing step; what it makes null goes."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", F.col("text").alias("sample"))
    trimmed = F.trim(F.col("sample"))
    out = training.prepared(docs, lambda r: (r["n_chars"] > 100) & (r["lang"] == "en"), lambda r: F.when(F.length(trimmed) > 0, F.lower(trimmed)))
    return out.select("doc_id", "sample")


_PRICE = "SELECT o_orderkey, upper(o_orderpriority) AS sample, o_orderkey % 5 = 0 AS dev FROM orders WHERE o_totalprice > 1000"


@query(f"""WITH o AS ({_PRICE}), t AS (SELECT * FROM o WHERE NOT dev ORDER BY md5(concat_ws('|', '{SEED}', o_orderkey::varchar)), o_orderkey LIMIT 200)
SELECT o_orderkey, sample, dev FROM t UNION ALL SELECT o_orderkey, sample, dev FROM o WHERE dev""")
def B12_training_data(spark: SparkSession, d: str) -> DataFrame:
    """A train set cut to a sample of 200, which is the feature, and a whole dev set, behind the same hooks."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("sample"))
    data = training.TrainingData(
        orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 5 = 0"), ["o_orderkey"], keep=lambda r: r["o_totalprice"] > 1000,
        preprocess=lambda r: F.upper(r["sample"]), sample_train=200, seed=SEED,
    )
    both = data.get_train().withColumn("dev", F.lit(False)).unionByName(data.get_dev().withColumn("dev", F.lit(True)))
    return both.select("o_orderkey", "sample", "dev")


@query("SELECT user_id, event_id, place, place // 8 AS batch FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events)")
def B13_candidate_samples(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    out = training.candidate_samples(events, "user_id", [F.col("ts"), F.col("event_id")], 8)
    return out.select("user_id", "event_id", "place", "batch")


@query("""SELECT 'type/' || event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY event_type
UNION ALL SELECT 'user/' || user_id AS name, round(avg(value), 6) AS value FROM events GROUP BY user_id""")
def A29_merged_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Two evaluations under prefixes of their own, as one; equal names would be refused."""
    events = table(spark, d, "events")
    mean = lambda by: events.groupBy(F.col(by).cast("string").alias("name")).agg(F.round(F.avg("value"), 6).alias("value"))
    return corpora.merged(corpora.prefixed(mean("event_type"), "type/"), corpora.prefixed(mean("user_id"), "user/"))


@query("""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT q.vec_id AS qid, p.vec_id AS sid, list_transform(list_zip(q.v, p.v), lambda z: z[1] + 0.5 * z[2]) AS r FROM s q JOIN s p ON p.vec_id = q.vec_id + 1 WHERE q.vec_id % 20 = 0)
SELECT qid, sid, i AS dim, round(r[i], 6) AS x FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM m)""")
def V08_reformulate_stored(spark: SparkSession, d: str) -> DataFrame:
    """Each question moved towards a paragraph's stored vector: the one after it."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), (F.col("vec_id") + 1).alias("sid"), F.col("embedding").alias("q"))
    met = asked.join(e.select(F.col("vec_id").alias("sid"), F.col("embedding").alias("p")), "sid")
    moved = met.select("qid", "sid", F.posexplode(V.reformulate(F.col("q"), F.col("p"))).alias("i", "x"))
    return moved.select("qid", "sid", (F.col("i") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"""WITH r AS (SELECT *, md5(concat_ws('|', '{SEED}', event_id::varchar)) AS u FROM events)
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY u, event_id) AS n FROM r) WHERE n <= 20""")
def B05_sample_by_group(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 20 of each group, which is the feature; each task keeps no more than that for a group."""
    draw = sampling.draw(SEED, "event_id")
    rows = table(spark, d, "events").select("event_type", "event_id")
    return sampling.sample_by_group(rows, "event_type", [draw, F.col("event_id")], 20)
