"""Hand-made and brute-force cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweave import protocols
from sparkweave.functions import spans as S
from sparkweave.functions import vectors as V
from sparkweave.operators import metrics as M
from sparkweave.operators import sampling, tfidf, training
from sparkweave.operators import spans as O
from sparkweave.operators import vectors as OV


def test_answer_scores(spark):
    rows = [(1, "yes", "yes sir"), (2, "a1 a1 b", "a1 b c"), (3, "", "x"), (4, "The cat", "cat")]
    df = spark.createDataFrame(rows, "id int, p string, g string")
    got = {r.id: r for r in M.answer_scores(df, ["id"], "p", "g").collect()}
    assert (got[1].f1, got[1].prec, got[1].recall) == (0, 0, 0)
    assert got[2].f1 == got[2].prec == got[2].recall == pytest.approx(2 / 3)
    assert (got[3].em, got[3].f1) == (0, 0) and (got[4].em, got[4].f1) == (1, 1)


def test_empty_sets(spark):
    s = spark.range(1).select(M.set_scores(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("s")).first().s
    assert (s.em, s.f1, s.prec, s.recall) == (1, 0, 0, 0)


def test_span_f1(spark):
    f1 = spark.range(1).select(S.overlap_f1(F.lit(2), F.lit(4), F.lit(3), F.lit(6)).alias("f")).first().f
    assert f1 == pytest.approx(4 / 7)


@pytest.mark.parametrize("bound", [None, 3])
def test_best_span(spark, bound):
    rng = random.Random(5)
    rows = [(q, i, rng.randint(0, 5) / 5, rng.randint(0, 5) / 5) for q in range(60) for i in range(rng.randint(1, 9))]
    got = {r.q: (r.start, r.end, r.score) for r in O.best_span(spark.createDataFrame(rows, "q int, pos int, p_start double, p_end double"), ["q"], bound).collect()}
    for q in range(60):
        own = [r for r in rows if r[0] == q]
        all_spans = [(a[2] * b[3], -b[1], -a[1]) for a in own for b in own if a[1] <= b[1] and (bound is None or b[1] - a[1] < bound)]
        best = max(s for s, *_ in all_spans)
        assert got[q][2] == pytest.approx(best)
        a, b = got[q][:2]
        assert own[a][2] * own[b][3] == pytest.approx(best) and a <= b and (bound is None or b - a < bound)


def test_disjoint_spans(spark):
    rows = [(1, 0, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 2, 0.5), (1, 0, 5, 1.0)]
    got = O.disjoint_spans(spark.createDataFrame(rows, "q long, s int, e int, score double"), "q", 3, 2).collect()
    assert [(r.s, r.e, r["rank"]) for r in got] == [(0, 1, 1), (2, 2, 2)]


def test_find_answers():
    assert O.find_answers("Bank of the America .".split(), [["bank", "of", "america"]]) == [(0, 3)]
    assert O.find_answers("x".split(), [["the"]]) == []
    assert O.find_answers("a b a b".split(), [["B"]]) == [(1, 1), (3, 3)]


def test_idf_clamp(spark):
    corpus = spark.createDataFrame([(i, "common " + w) for i, w in enumerate("abcdefgh")], "doc_id long, text string")
    index = tfidf.postings(corpus, n=1)
    weights = tfidf.weighted(index, tfidf.document_frequency(index), tfidf.count_documents(corpus))
    assert {r.weight for r in weights.where("term = 'common'").collect()} == {0.0}


def test_fold_ranks_as_the_layer_does(spark):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows, w = [(i, vec(), vec()) for i in range(40)], [F.array(*map(F.lit, vec())) for _ in range(3)]
    q = F.array(*map(F.lit, vec()))
    df = spark.createDataFrame(rows, "id int, p array<double>, x array<double>")
    both = df.select("id", V.dot(V.fold_query(q, *w, 0.3), F.col("p")).alias("a"), V.merged_score(F.col("p"), q, *w, 0.3).alias("b")).collect()
    assert [r.id for r in sorted(both, key=lambda r: r.a)] == [r.id for r in sorted(both, key=lambda r: r.b)]


def test_top_k_grows_by_appending(spark):
    df = spark.createDataFrame([(1, i, float(i % 7)) for i in range(30)], "q int, sid int, score double")
    ids = lambda k: [r.sid for r in OV.top_k(df, ["q"], k, ["sid"]).orderBy("rank").collect()]
    assert ids(9)[:5] == ids(5)


def test_batches(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = {r.batch: r["count"] for r in sampling.batches(df, [F.col("k")], 10).groupBy("batch").count().collect()}
    assert sizes == {**{i: 10 for i in range(10)}, 10: 3}
    assert sampling.batches(df, [F.col("k")], 10, keep_remainder=False).count() == 100
    assert sampling.sample(df, 1, ["k"], 7).count() == 7
    assert sorted(r.n for r in sampling.numbered(df, [F.desc("k")]).collect()) == list(range(103))


def test_choose_shares(spark):
    kinds = spark.range(20000).select(sampling.choose(3, ["id"], [("a", 0.7), ("b", 0.3)]).alias("k")).groupBy("k").count().collect()
    assert abs({r.k: r["count"] for r in kinds}["a"] / 20000 - 0.7) < 0.02


def test_auc_with_ties(spark):
    rows = [(i % 5, i % 3 == 0) for i in range(60)]
    got = M.auc_and_precision(spark.createDataFrame(rows, "s int, l boolean"), "s", F.col("l")).first()
    pos, neg = [s for s, l in rows if l], [s for s, l in rows if not l]
    assert got.auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg), abs=1e-6)


def test_kendall(spark):
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 3), (3, 2), (4, 4)])]
    assert M.kendall_tau(spark.createDataFrame(rows, "g int, ord int, x double, y double"), "g", "x", "y").first().tau == pytest.approx(4 / 6, abs=1e-6)


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        protocols.tokenizer("none")


def test_encoder_is_deterministic(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    got = {r.id: r.vector for r in protocols.encode(df, protocols.HashedEncoder(8), ["id"], "t").collect()}
    assert got[1] == protocols.HashedEncoder(8).encode(["a b"])[0].tolist() and set(got[2]) == {0.0}


def test_encoder_by_another_loop():
    import zlib

    texts, size = ["The cat the CAT sat", "", "dog", "a b c a"], 8
    want = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if (h >> 16) % 2 else -1
        n = sum(x * x for x in v) ** 0.5
        want.append([x / n if n else 0.0 for x in v])
    got = protocols.HashedEncoder(size).encode(texts)
    assert [pytest.approx(row) for row in want] == got.tolist()


def test_python_tokenizer(spark):
    if "halves" not in protocols.TOKENIZERS:
        protocols.register_tokenizer("halves", lambda: protocols.PythonTokenizer(lambda: lambda t: [t[: len(t) // 2], t[len(t) // 2 :]]))
    with pytest.raises(ValueError):
        protocols.register_tokenizer("halves", protocols.SimpleTokenizer)
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.x for r in df.select("id", protocols.tokenizer("halves").tokens(F.col("t")).alias("x")).collect()}
    assert got == {1: ["ab", "cd"], 2: [], 3: []}


def test_training_data(spark):
    rows = spark.createDataFrame([(i, f" t{i} " if i % 4 else None) for i in range(40)], "k int, sample string")
    data = training.TrainingData(
        rows.where("k < 30"), rows.where("k >= 30"), ["k"], keep=lambda r: r["k"] != 5, preprocess=lambda r: F.trim(r["sample"]), sample_train=6
    )
    train, dev = data.get_train().collect(), data.get_dev().collect()
    assert len(train) == 6 and {r.k for r in train} <= {i for i in range(30) if i % 4 and i != 5} and all(r.sample == f"t{r.k}" for r in train)
    assert {r.k for r in data.get_train().collect()} == {r.k for r in train}
    assert {r.k for r in dev} == {i for i in range(30, 40) if i % 4}


def test_short_and_odd_answers(spark, tmp_path):
    from sparkweave.plans.text_queries import P08_answer_in_text

    items = ["a b c d e f", "on the mat", "cat", "ca", "c", "", "the  cat", "the cat sat on the mat", " sat", "zz", None, "t\ncat x y z w v"]
    texts = ["the cat sat on the mat", "the  cat", "", "concatenate", "xa b c d e fy", None, "the cat\nsat on the mat", "that\ncat x y z w vv"]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "t" / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    got = {(r.item_id, r.doc_id) for r in P08_answer_in_text(spark, str(tmp_path / "t")).collect()}
    assert got == {(i, j) for i, a in enumerate(items) for j, t in enumerate(texts) if a is not None and t is not None and a in t}
    plan = P08_answer_in_text(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
