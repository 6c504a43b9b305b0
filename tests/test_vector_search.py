"""Searches of vectors: pairs never become rows, and results are those of all pairs."""

import numpy as np
import pytest

from sparkweave import plans, registry  # noqa: F401
from sparkweave.functions import arrow_vectors as A
from sparkweave.operators import vectors as O

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(O, "ASKED", 3)
    monkeypatch.setattr(O, "HELD", 5)


def sides(spark):
    """Copies, a null vector, one of another length and one with a null in it; two titles for most questions."""
    draw = np.random.default_rng(7)
    vector = lambda: [float(x) for x in draw.integers(-9, 9, 4) / 8]
    odd = {3: None, 4: [1.0, 2.0], 5: [1.0, None, 0.0, 0.0]}
    held = [(s, s // 2, s % 3, odd.get(s, [0.5, 0.5, 0.0, 1.0] if s % 4 == 0 else vector())) for s in range(40)]
    asked = [(q, q % 3, vector() if q else None) for q in range(8)]
    questions = spark.createDataFrame([(q, v) for q, _, v in asked], "qid long, q array<double>")
    candidates = spark.createDataFrame([(q, t) for q, t, _ in asked] + [(q, (t + 1) % 3) for q, t, _ in asked if q != 2], "qid long, title long")
    return questions, candidates, spark.createDataFrame(held, "sid long, paragraph long, title long, v array<double>")


@pytest.mark.parametrize("k", [1, 3, 30])
def test_search_is_that_of_all_pairs(spark, small_blocks, k):
    questions, candidates, held = sides(spark)
    asked = candidates.join(questions, "qid")
    want = O.top_k(O.inner_products(asked.join(held, "title")), ["qid"], k, ["sid"]).select("qid", "sid", "score", "rank")
    found = O.top_k(O.search(asked, held, candidates, k, ["sid"]), ["qid"], k, ["sid"]).select("qid", "sid", "score", "rank")
    assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)


def test_rounded_as_spark(spark):
    x = [0.0000005, -0.0000005, 1.0000005, 2.5000015, -3e-9, 123456789.1234565, 1e300, 0.1234565, float("nan"), float("inf")]
    frame = spark.createDataFrame([(v,) for v in x], "x double").selectExpr("round(x, 6) as r")
    assert [str(r.r) for r in frame.collect()] == [str(v) for v in A.rounded(np.array(x), 6).tolist()]


@pytest.mark.parametrize(
    "name, searches",
    [
        ("J21_two_hop_retrieval", 2),
        ("J20_hop2_paths", 2),
        ("J26_mixed_hops", 3),
        ("J23_two_hop_older", 2),
        ("A17_pair_stats_at_k", 2),
        ("V07_attention_reformulate", 1),
        ("J22_two_hop_wide", 2),
    ],
)
def test_pairs_are_no_rows(spark, name, searches):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == searches


def test_a_vector_is_sent_once_for_thousands_of_questions(spark):
    """Each block of questions gets all sentences of its title, so blocks are large."""
    asked = spark.range(8000).selectExpr("id as qid", "0L as title", "array(1d, 0d) as q")
    held = spark.range(10000).selectExpr("id as sid", "id as paragraph", "0L as title", "array(0d, 1d) as v")
    cells = O._cells(asked, held, asked.select("qid", "title"), 1)
    assert cells._gd1._df.count() == 8000
    assert cells._gd2._df.count() == 10000


@pytest.mark.parametrize("k1", [1, 2, 5])
def test_two_hops_are_those_of_all_pairs(spark, small_blocks, k1):
    """Paragraphs lie in two titles and several blocks; the first search gives their vectors too."""
    questions, candidates, held = sides(spark)
    by_rows = lambda asked: O.inner_products(asked.join(held, "title"))
    first = O.best_paragraphs(by_rows(candidates.join(questions, "qid")), ["qid"], ["paragraph"], ["sid"], k1, 3)
    cut = O.top_k(by_rows(candidates.join(questions, "qid")), ["qid"], 3 * k1, ["sid"])
    at = cut.join(first.select("qid", "paragraph", "first_rank"), ["qid", "paragraph"]).where("rank = first_rank")
    paths = at.select("qid", O.F.col("paragraph").alias("p1"), O.V.reformulate(O.F.col("q"), O.F.col("v")).alias("q"))
    second = by_rows(candidates.join(paths, "qid")).withColumnRenamed("paragraph", "p2")
    want = O.best_paragraphs(second, ["qid"], ["p1", "p2"], ["p1", "sid"], 7, 3).select("qid", "p1", "p2", "score", "rank")
    rows = lambda f: sorted(map(str, f.collect()))
    assert rows(O.two_hops(questions, candidates, candidates, held, k1, 7, 3)) == rows(want)
    other = candidates.where("title < 3")  # another frame
    mixed = O.two_hops(questions, candidates, other, held, k1, 7, 3, mixed=True)
    assert rows(mixed.where("hop = 2").select(want.columns)) == rows(want)
    assert rows(mixed.where("hop = 1").select("qid", "p1", "rank")) == rows(first.selectExpr("qid", "paragraph as p1", "rank"))


@pytest.mark.parametrize("name", ["A17_pair_stats_at_k", "J20_hop2_paths", "J21_two_hop_retrieval", "J22_two_hop_wide", "J23_two_hop_older", "J26_mixed_hops"])
def test_vectors_travel_once(spark, name):
    """Not for each search, nor for the sizes of titles, nor to be fetched for paths."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own = [line for line in plan if "Exchange hashpartitioning(title#" in line and "_qb#" in line and "Reused" not in line]
    assert len(own) == 3  # questions, paths and sentences
    assert sum("FileScan" in line and "embedding#" in line for line in plan) == 2  # by questions and by sentences


def test_titles_that_are_null_or_on_one_side_have_no_pairs(spark, small_blocks):
    asked = spark.createDataFrame([(1, 1, [1.0]), (2, None, [1.0]), (3, 3, [1.0])], "qid long, title long, q array<double>")
    held = spark.createDataFrame([(1, 1, [1.0]), (2, None, [1.0]), (4, 4, [1.0])], "sid long, title long, v array<double>")
    assert [tuple(r) for r in O.search(asked, held, asked, 3, ["sid"]).collect()] == [(1, 1, 1.0)]
