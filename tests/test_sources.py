"""Readers and stores."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import tfidf
from sparkweave.sources import corpora, readers, stores
from sparkweave.streaming.questions import answer_stream


def test_wiki_dump(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    docs = [
        {"id": "1", "url": "u", "title": "One", "text": [["One"], ["A first sentence.", "And <a href='x'>more</a>."]], "charoffset": [[[[0, 1]]]]},
        {"id": "38754454", "url": "u", "title": "Two", "text": [["Two"], ["Another sentence here."]], "charoffset": []},
    ]
    (tmp_path / "AA" / "wiki_00.bz2").write_bytes(bz2.compress("\n".join(map(json.dumps, docs)).encode()))
    dump = readers.wiki_dump(spark, str(tmp_path))
    lead = readers.lead_sentences(dump).collect()
    assert [(r.title, r.sentences) for r in lead] == [("One", ["A first sentence.", " And more."])]
    assert readers.all_paragraphs(dump).first().paragraphs == [["One"], ["A first sentence.", "And more."]]


def test_nested_questions(spark, tmp_path):
    data = {"data": [{"title": "T", "paragraphs": [{"context": "c", "qas": [{"id": "q", "question": "?", "answers": [{"text": "a"}]}]}]}]}
    (tmp_path / "f.json").write_text(json.dumps(data, indent=1))
    row = readers.nested_questions(spark, str(tmp_path / "f.json")).first()
    assert (row.title, row.par_id, row.qid, row.answers) == ("T", 0, "q", ["a"])


def test_line_questions(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\n".join(json.dumps({"question": f"q{i}", "answer": "x"}) for i in range(7)))
    assert sorted((r.qid, r.question) for r in readers.line_questions(spark, str(tmp_path / "q.txt")).collect()) == [(i, f"q{i}") for i in range(7)]


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes(b"The 1 2\nbad\xff 1 2\ncat 3 4\nhead x y\n")
    got = readers.word_vectors(spark, str(tmp_path / "v.txt"), spark.createDataFrame([("the",)], "word string")).collect()
    assert [(r.word, r.vector) for r in got] == [("The", [1.0, 2.0])]


def test_word_counts(spark, tmp_path):
    stores.write_word_counts(spark.createDataFrame([("a", 1), ("b", 5), (" ", 9)], "word string, n long"), str(tmp_path / "c"))
    assert {(r.word, r.n) for r in readers.word_counts(spark, str(tmp_path / "c")).collect()} == {("a", 1), ("b", 5)}


def test_document_store(spark, tmp_path):
    store = stores.DocumentStore(spark, str(tmp_path / "docs"))
    docs = spark.createDataFrame([("A", ["x", "y"]), ("B", ["z"])], "title string, sentences array<string>")
    with pytest.raises(stores.DuplicateKeys):
        store.create(docs.unionByName(docs))
    store.create(docs)
    with pytest.raises(Exception):
        store.create(docs)
    got = {r.title: r.sentences for r in store.sentences(spark.createDataFrame([("A",), ("C",)], "title string")).collect()}
    assert got == {"A": ["x", "y"], "C": None}
    with pytest.raises(ValueError):
        store.paragraphs(docs)


def test_encoding_store(spark, tmp_path):
    store = stores.EncodingStore(spark, str(tmp_path / "enc"))
    row = lambda t, x: spark.createDataFrame([(t, 0, 0, [x])], "title string, par_id int, sent_id int, vector array<double>")
    store.append(row("A", 1.0))
    store.append(row("B", 2.0))
    with pytest.raises(stores.DuplicateKeys):
        store.append(row("A", 3.0))
    store.append(row("A", 3.0), overwrite=True)
    assert {r.title: r.vector for r in store.read().collect()} == {"A": [3.0], "B": [2.0]}
    # A version that isn't whole is as if it weren't there.
    (tmp_path / "enc" / "v9").mkdir()
    store.append(row("D", 4.0))
    assert {r.title for r in store.read().collect()} == {"A", "B", "D"}
    assert [r.title for r in store.missing(spark.createDataFrame([("A",), ("C",)], "title string")).collect()] == ["C"]


def test_predictions_entry_by_entry(spark, tmp_path):
    """Each entry is a line, so no task holds the whole object; odd keys and answers that look like facts come back."""
    kind = "qid string, answer string, sp array<struct<title:string,sent_id:int>>"
    rows = [('q"1": [', "[[", [('a": [', 0)]), ("back\\", "null", []), ("n", None, [("T", 3), ("", 4)]), (", x", "a\r\n\u2028b", None)]
    for name, some in (("some", rows), ("none", [])):
        path = tmp_path / name
        stores.write_predictions(spark.createDataFrame(some, kind), str(path))
        (file,) = path.glob("part-*")
        assert len(file.read_bytes().splitlines()) == 3 + sum(1 + (sp is not None) for _, _, sp in some)
        assert json.loads(file.read_text())["answer"] == {q: a for q, a, _ in some}
        found = readers.predictions(spark, str(path))
        assert {r.qid: (r.answer, r.sp and [tuple(f) for f in r.sp]) for r in found.collect()} == {q: (a, sp) for q, a, sp in some}


def test_predictions_and_grid(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"answer": {"q1": "x"}, "sp": {"q1": [["T", 1]]}}))
    row = readers.predictions(spark, str(tmp_path / "p.json")).first()
    assert (row.qid, row.answer, row.sp[0].title, row.sp[0].sent_id) == ("q1", "x", "T", 1)
    kind = "qid string, answer string, sp array<struct<title:string,sent_id:int>>"
    rows = [("q1", 'an "odd" é answer\n', [("A \"b\"", 0), ("C", 12)]), ("q2", "yes", []), ("q 3", None, None)]
    stores.write_predictions(spark.createDataFrame(rows, kind), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    whole = json.loads(file.read_text())
    assert whole == {"answer": {q: a for q, a, _ in rows}, "sp": {q: [list(f) for f in sp] for q, _, sp in rows if sp is not None}}
    back = {r.qid: (r.answer, r.sp and [tuple(f) for f in r.sp]) for r in readers.predictions(spark, str(tmp_path / "out")).collect()}
    assert back == {q: (a, sp) for q, a, sp in rows}
    grid = spark.createDataFrame([("q", 1, 2)], "qid string, n1 int, n2 int")
    stores.write_grid(grid, str(tmp_path / "grid"))
    assert spark.read.json(str(tmp_path / "grid")).where("n2 = 2 and n1 = 1").count() == 1


def test_results_round_trip(spark, tmp_path):
    values = {name: None for name in [c.split()[0] for c in readers.RESULTS.split(", ")]}
    rows = spark.createDataFrame([tuple(values.values())], readers.RESULTS)
    rows = rows.withColumn("predicted_sp", F.array(F.struct(F.lit('T"x').alias("title"), F.lit(1).alias("sent_id")))).withColumn("titles", F.array(F.lit("a,b")))
    stores.write_results(rows, str(tmp_path / "r"))
    back = readers.results(spark, str(tmp_path / "r")).first()
    assert back.predicted_sp[0].title == 'T"x' and back.titles == ["a,b"]


def test_blob_round_trip(spark):
    df = spark.createDataFrame([(["a", "é"],)], "x array<string>")
    assert df.select(readers.legacy_blob(readers.legacy_encode(F.col("x"))).alias("y")).first().y == ["a", "é"]


def test_question_stream(spark, tmp_path):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue whale", "green frog", "grey wolf", "black cat", "white hen"])], "doc_id long, text string")
    spark.createDataFrame([(1, "blue whale"), (2, "black cat")], "qid long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "in"))
    answer_stream(stream, tfidf.postings(corpus), corpus, 1, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.qid, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1), (2, 4)}


def test_split_corpus(spark, tmp_path):
    rows = lambda *t: spark.createDataFrame([(x, x.lower()) for x in t], "title string, text string")
    corpus = corpora.SplitCorpus(spark, str(tmp_path / "c"))
    with pytest.raises(stores.DuplicateKeys):
        corpus.write(train=rows("A", "B"), dev=rows("B"))
    with pytest.raises(ValueError):
        corpus.write(other=rows("A"))
    corpus.write(train=rows("A", "B"), dev=rows("C"))
    assert {r.title for r in corpus.split("train").collect()} == {"A", "B"} and corpus.split("dev").columns == ["title", "text"]
    with pytest.raises(Exception):
        corpus.write(train=rows("D"))


def test_index_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red wolf")], "doc_id long, text string")
    store = corpora.IndexStore(spark, str(tmp_path / "i"))
    store.write(tfidf.postings(docs), n=2, mode="any")
    assert store.metadata() == {"n": 2, "mode": "any"}
    assert sorted(store.postings().collect()) == sorted(tfidf.postings(docs).collect())


def test_merged_evaluations(spark):
    one = spark.createDataFrame([("em", 0.5), ("f1", 0.6)], "name string, value double")
    both = corpora.merged(corpora.prefixed(one, "dev/"), one)
    assert {r.name for r in both.collect()} == {"dev/em", "dev/f1", "em", "f1"}
    with pytest.raises(stores.DuplicateKeys):
        corpora.merged(one, one)
