"""Readers of corpora, question sets, word lists and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WIKI = "id string, url string, title string, text array<array<string>>, charoffset array<array<array<array<int>>>>"
#: Fixed value: documents that are never read.
REJECTED_IDS = ("38754454",)
FACT = "struct<title:string,sent_id:int>"
RESULTS = (
    "n_answers int, text_answer string, predicted_sp string, sp_em double, sp_f1 double, joint_em double, joint_f1 double, "
    "predicted_score double, predicted_start int, predicted_end int, span_question_scores double, yes_no_question_scores double, "
    "yes_no_confidence_scores double, text_f1 double, rank int, text_em double, question_id string, type string, titles string"
)


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a dump of JSON lines, in folders of any depth; bzip2 files are split among tasks."""
    return spark.read.schema(WIKI).option("recursiveFileLookup", True).json(path).where(~F.col("id").isin(*REJECTED_IDS))


def lead_sentences(dump: DataFrame, min_chars: int = 500) -> DataFrame:
    """(id, title, url, sentences, charoffset) of documents with a lead of ten characters or more."""
    lead = dump.select("id", "title", "url", T.lead_sentences(F.col("text"), min_chars).alias("sentences"), "charoffset")
    return lead.where("sentences is not null")


def all_paragraphs(dump: DataFrame) -> DataFrame:
    """(id, title, url, paragraphs) without empty sentences and paragraphs."""
    clean = dump.select("id", "title", "url", T.clean_paragraphs(F.col("text")).alias("paragraphs"))
    return clean.where("paragraphs is not null")


def whole_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array or object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def nested_questions(spark: SparkSession, path: str) -> DataFrame:
    """(title, par_id, context, qid, question, answers) of articles with paragraphs with questions."""
    answers = "array<struct<text:string>>"
    schema = f"data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:{answers}>>>>>>"
    return flatten_questions(whole_json(spark, path, schema))


def flatten_questions(nested: DataFrame) -> DataFrame:
    articles = nested.select(F.explode("data").alias("a"))
    paragraphs = articles.select("a.title", F.posexplode("a.paragraphs").alias("par_id", "p"))
    asked = paragraphs.select("title", "par_id", "p.context", F.explode("p.qas").alias("q"))
    return asked.select("title", "par_id", "context", F.col("q.id").alias("qid"), "q.question", F.col("q.answers.text").alias("answers"))


def line_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, answer) of JSON lines; the line number, from 0, is the id.

    A file is read whole by one task, for a line's number is known only to who has read
    those before it; question sets are small beside a corpus. Of several files the
    lines are numbered within each, and ``file`` tells them apart.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("l"))
    lines = whole.select("file", F.posexplode("l").alias("qid", "line"))
    parsed = F.from_json("line", "question string, answer string")
    return lines.select(F.col("qid").cast("long").alias("qid"), parsed.alias("r"), "file").select("qid", "r.question", "r.answer", "file")


def word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, vector) of a text file, plain or compressed; only words of the vocabulary (word), in lower case.

    Lines that aren't valid UTF-8 or have no numbers are left out.
    """
    lines = spark.read.text(path).where(~F.contains("value", F.lit("�")))
    parts = lines.select(F.split("value", " ").alias("p"))
    rows = parts.select(F.get("p", 0).alias("word"), F.transform(F.slice("p", 2, F.greatest(F.lit(0), F.size("p") - 1)), lambda x: x.try_cast("float")).alias("vector"))
    rows = rows.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    if vocabulary is None:
        return rows
    known = vocabulary.select(F.lower("word").alias("known")).distinct()
    return rows.join(known, F.lower("word") == F.col("known"), "left_semi")


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) of a table with tabs; blank words are left out."""
    rows = spark.read.option("sep", "\t").schema("word string, n long").csv(path)
    return rows.where("trim(word) <> ''")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with their list columns as arrays."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(RESULTS).csv(path)
    return rows.withColumn("predicted_sp", F.from_json("predicted_sp", f"array<{FACT}>")).withColumn("titles", F.from_json("titles", "array<string>"))


def legacy_blob(column: Column, kind: str = "array<string>") -> Column:
    """A base64 text of JSON as a value."""
    return F.from_json(F.unbase64(column).cast("string"), kind)


def legacy_encode(column: Column) -> Column:
    return F.base64(F.to_json(column).cast("binary"))


def _by_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(qid, answer) and (qid, sp) of an object with a line for each entry; a fact list is what starts with a bracket."""
    line = F.regexp_replace("value", "^, ", "")
    name = r'^"(?:[^"\\]|\\.)*+": '
    entries = spark.read.text(path).select(line.alias("value")).where(F.col("value").rlike(name))
    facts = F.col("value").rlike(name + r"\[")
    of = lambda kind: F.explode(F.from_json(F.concat(F.lit("{"), F.col("value"), F.lit("}")), f"map<string,{kind}>"))
    return entries.where(~facts).select(of("string").alias("qid", "answer")), entries.where(facts).select(of("array<array<string>>").alias("qid", "sp"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answer, sp) of a file with one object of answers and one of facts, each fact [title, sentence].

    What ``write_predictions`` wrote is read by lines, in many tasks; any other file as one value.
    """
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_entries")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        answers, listed = _by_lines(spark, path)
    else:
        one = whole_json(spark, path, "answer map<string,string>, sp map<string,array<array<string>>>")
        answers, listed = one.select(F.explode("answer").alias("qid", "answer")), one.select(F.explode("sp").alias("qid", "sp"))
    fact = lambda f: F.struct(F.get(f, 0).alias("title"), F.get(f, 1).cast("int").alias("sent_id"))
    facts = listed.select("qid", F.transform("sp", fact).alias("sp"))
    return answers.join(facts, "qid", "full")
