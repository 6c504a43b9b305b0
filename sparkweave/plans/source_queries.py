"""Stores, lookups and nested sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import readers
from .text_queries import T02_lead_paragraph, T03_clean_paragraphs
from ..registry import ORACLE_SQL


@query(ORACLE_SQL["T02_lead_paragraph"])
def S02_sentence_scan(spark: SparkSession, d: str) -> DataFrame:
    return T02_lead_paragraph(spark, d)


@query(ORACLE_SQL["T03_clean_paragraphs"])
def S03_paragraph_scan(spark: SparkSession, d: str) -> DataFrame:
    return T03_clean_paragraphs(spark, d)


@query("SELECT l.doc_id, n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en'")
def S05_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Keys with a value, null where it isn't known."""
    known = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    return table(spark, d, "labels").select("doc_id").join(known, "doc_id", "left")


@query("SELECT l.doc_id, len(string_split(text, chr(10))) AS n_paragraphs FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def S06_paragraph_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n")).cast("long"))
    known = table(spark, d, "documents").select("doc_id", lines.alias("n_paragraphs"))
    return table(spark, d, "labels").select("doc_id").join(known, "doc_id", "left")


@query("SELECT doc_id FROM documents")
def S07_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id")


@query("SELECT page_id, url, length(html) AS n FROM pages WHERE url LIKE 'http://%'")
def S08_legacy_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").startswith("http://")).select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("SELECT doc_id, md5(array_to_string(string_split(coalesce(text, ''), chr(10)), '|')) AS back FROM documents")
def S09_blob_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a base64 text of JSON, and back."""
    blob = readers.legacy_encode(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = table(spark, d, "documents").select("doc_id", readers.legacy_blob(blob).alias("l"))
    return rows.select("doc_id", F.md5(F.array_join("l", "|").cast("binary")).alias("back"))


@query("SELECT 'order ' || l_orderkey AS title, l_linenumber - 1 AS par_id, l_partkey::varchar AS qid, count(*) AS n FROM lineitem GROUP BY ALL")
def S11_nested_questions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as articles, line numbers as paragraphs, parts as questions: nested, then flattened."""
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("order "), "l_orderkey").alias("title"), "l_linenumber", F.col("l_partkey").cast("string").alias("id"))
    qas = F.collect_list(F.struct("id", F.lit("?").alias("question"), F.array(F.struct(F.lit("a").alias("text"))).alias("answers")))
    pars = lines.groupBy("title", "l_linenumber").agg(qas.alias("qas"))
    # Line numbers may have gaps, so the number is carried as the context.
    nested = pars.groupBy("title").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("context"), "qas")).alias("paragraphs"))
    flat = readers.flatten_questions(nested.select(F.array(F.struct("title", "paragraphs")).alias("data")))
    return flat.groupBy("title", (F.col("context").cast("int") - 1).alias("par_id"), "qid").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, arg_max(l_comment, ord) AS text FROM (SELECT l_partkey, l_orderkey || ':' || l_linenumber AS l_comment, (l_orderkey, l_linenumber, l_shipdate) AS ord FROM lineitem) GROUP BY l_partkey")
def S13_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by(text, F.struct("l_orderkey", "l_linenumber", "l_shipdate")).alias("text"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def S15_reattach_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """A fact table without its dimension's text, which a join brings back."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, d, "lineitem").join(orders, "l_orderkey").groupBy("l_orderkey", "l_linenumber", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (SELECT DISTINCT label FROM embeddings WHERE vec_id < 3) GROUP BY label")
def S17_append_missing(spark: SparkSession, d: str) -> DataFrame:
    """Titles still to be encoded, when those of the first three vectors are."""
    e = table(spark, d, "embeddings")
    return e.join(e.where("vec_id < 3").select("label").distinct(), "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT p_type AS word, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY p_type")
def S20_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("trim(p_type) <> ''").groupBy(F.col("p_type").alias("word")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def S24_semi_join(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("SELECT DISTINCT p_brand AS word FROM part")
def S25_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("word")).distinct()
