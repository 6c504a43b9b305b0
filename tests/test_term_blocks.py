"""Weights of all terms of all texts by blocks: results are those of postings as rows, which are none here."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.window import Window as W

from sparkweave import plans, registry  # noqa: F401
from sparkweave.functions import arrow_terms as A
from sparkweave.operators import term_blocks as B
from sparkweave.operators import tfidf

DATA = "/root/testdata/sf0.001"
TEXTS = [
    (1, "red fox runs\nred fox sleeps\n\nthe blue bird, the red one"), (2, "one line only"), (3, None), (4, ""),
    (5, "\nfirst line is empty\nred fox"), (6, "of the\nred fox of the\nof the"), (7, "Ärger im Haus\nim ÄRGER haus\nnichts"),
    (8, "red red red fox fox\nfox red\nfox red\nred fox"), (None, "no name here\nno name there"),
    (9, "twice the same id\nsame id here"), (9, "twice another text\nid same there\nthird line twice"),
]


@pytest.fixture(params=[8, 1 << 22])
def chars(request, monkeypatch):
    monkeypatch.setattr(B, "CHARS", request.param)
    monkeypatch.setattr(B, "SHARE", 2)


def by_rows(corpus):
    """Distances to the first line by joins of postings."""
    lines = corpus.selectExpr("doc_id", "posexplode(split(coalesce(text, ''), '\n')) as (at, text)").selectExpr("doc_id", "at + 1L as i", "text")
    index = tfidf.postings(lines, ["doc_id", "i"])
    unit = tfidf.unit_vectors(index, ["doc_id", "i"], tfidf.smooth_idf(index, tfidf.count_documents(lines)))
    gold = unit.where("i = 1").selectExpr("doc_id", "term", "weight as g")
    return unit.where("i <> 1").join(gold, ["doc_id", "term"]).groupBy("doc_id", "i").agg(B.F.round(1 - B.F.sum(B.F.expr("weight * g")), 6) + 0.0)


def test_distances_are_those_of_postings(spark, chars):
    corpus = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert sorted(map(tuple, B.first_line_distances(corpus).collect())) == sorted(map(tuple, by_rows(corpus).collect()))


@pytest.mark.parametrize("name", ["J09_within_document_rank", "J10_document_distractors", "J12_align_paragraph", "J16_global_paragraph_rank"])
def test_postings_are_no_rows(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "term" not in plan.replace("term_blocks", "")


ASKED = [(1, "red fox"), (2, "same id\nblue bird"), (3, "haus name line"), (4, "of the"), (5, None), (6, "unknown words"), (7, "fox red red fox sleeps")]


@pytest.mark.parametrize("k", [1, 3])
def test_best_lines_and_texts_are_those_of_postings(spark, chars, k):
    corpus = spark.createDataFrame([t for t in TEXTS if t[0] is not None], "doc_id long, text string")
    asked = spark.createDataFrame(ASKED, "qid long, text string")
    lines = corpus.selectExpr("doc_id", "posexplode(split(coalesce(text, ''), '\n')) as (at, text)").selectExpr("doc_id", "at + 1L as i", "text")
    index = tfidf.postings(lines, ["doc_id", "i"])
    rated = tfidf.smooth_idf(index, tfidf.count_documents(lines))
    unit = tfidf.unit_vectors(index, ["doc_id", "i"], rated)
    near = tfidf.cosine_distance(tfidf.unit_vectors(tfidf.postings(asked, "qid"), "qid", rated), unit, "qid", ["doc_id", "i"])
    ranked = lambda f, *order: sorted(map(tuple, f.withColumn("r", B.F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(f"r <= {k}").collect()))
    assert ranked(B.nearest_lines(asked, corpus, k), "distance", "doc_id", "i") == ranked(near, "distance", "doc_id", "i")
    scored = tfidf.scores(tfidf.postings(asked, "qid"), tfidf.postings(corpus), corpus)
    wanted = spark.createDataFrame([(1, 1), (1, 8), (2, 2), (3, 7), (4, 1)], "qid long, doc_id long")
    found = B.best_texts(asked, B.Index(corpus, by_line=False), k, wanted)
    assert ranked(found.where("not wanted").drop("wanted"), B.F.desc("score"), "doc_id") == ranked(scored, B.F.desc("score"), "doc_id")
    given = sorted(map(tuple, found.where("wanted").drop("wanted").collect()))
    assert given == sorted(map(tuple, scored.join(wanted, ["qid", "doc_id"], "left_semi").collect()))


@pytest.mark.parametrize("numbers", [[], [0], [255, 256, 0], [1 << 63, 5, (1 << 64) - 1], list(range(70000))])
@pytest.mark.parametrize("raw", [0, 5])
def test_packed_numbers_come_back(numbers, raw):
    x = np.array(numbers, np.uint64)
    assert A.unpacked(A.packed(x, raw)).tolist() == numbers
    keys = np.sort(x)
    assert A.unpacked_keys(A.packed_keys(keys)).tolist() == keys.tolist()


def test_asked_keys_and_counts_are_packed():
    """Less than 7 bytes for a key and its count, which took 16; the answers are those of the block itself."""
    words = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 100_000)
    table = pa.table({"block": pa.array([0], pa.int32()), "id": [7], "words": [[words.tolist()]]})
    terms, asked = A.Terms(table, np.zeros(1, np.int64)), A.ask(3, np.zeros(1, np.int64))(table)
    assert asked["bucket"].to_pylist() == [0, 1, 2]
    sizes = [len(x) for c in ("keys", "counts") for x in asked[c].to_pylist()]
    assert sum(sizes) < 7 * len(terms.vocab)
    told = pa.concat_tables([A.answer(asked.slice(b, 1)) for b in (2, 0, 1)])
    assert terms.frequencies(told, 3).tolist() == [1] * len(terms.vocab)
