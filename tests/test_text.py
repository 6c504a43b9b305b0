"""Hand-made cases of the text functions."""

import hashlib
import re
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweave import plans, registry  # noqa: F401
from sparkweave.functions import pandas_text as P
from sparkweave.functions import text as T
from sparkweave.operators import tfidf


def one(spark, column, **values):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_normalize_answer(spark):
    assert one(spark, T.normalize_answer(F.col("t")), t="The  U.S.A., a test") == "usa test"
    assert one(spark, T.normalize_answer(F.col("t")), t="a.b") == "ab"


@pytest.mark.parametrize("mode, want", [("any", ["new", "york"]), ("all", ["new", "new the", "the york", "york"]), ("ends", ["new", "york"])])
def test_ngram_filter(spark, mode, want):
    assert one(spark, T.ngrams(F.col("t"), 2, mode=mode), t=["new", "the", "york"]) == want


def test_ngrams_without_filter(spark):
    assert one(spark, T.ngrams(F.col("t"), 2), t=["a", "b", "c"]) == ["a", "a b", "b", "b c", "c"]
    assert one(spark, T.ngrams(T.tokens(F.col("t")), 2), t="") == []


def test_unknown_mode():
    with pytest.raises(ValueError):
        T.drop_ngram(None, "some")


def test_sentence_segments(spark):
    assert one(spark, T.sentence_segments(F.col("t")), t=["a", ".", "b", "."]) == [0, 0, 1, 1]


def test_paragraph_name(spark):
    assert one(spark, T.name_title(F.col("t")), t="A_B_3") == "A_B"
    assert one(spark, T.name_number(F.col("t")), t="A_B_3") == 3


def test_lead_paragraph(spark):
    document = [["title"], ["x" * 300], ["y" * 300], ["z"]]
    assert one(spark, T.lead_sentences(F.col("t")), t=document) == ["x" * 300, " " + "y" * 300]
    assert one(spark, T.lead_sentences(F.col("t")), t=[["title"], ["short"]]) is None
    # An empty first sentence still counts as the first place.
    assert one(spark, T.lead_sentences(F.col("t")), t=[["t"], ["", "later than first"]]) == [" later than first"]


def test_clean_paragraphs(spark):
    assert one(spark, T.clean_paragraphs(F.col("t")), t=[["<a href='x'>b</a>", ""], [""]]) == [["b"]]
    assert one(spark, T.clean_paragraphs(F.col("t")), t=[[""]]) is None


def test_shift_supporting(spark):
    column = T.shift_supporting(F.col("s"), F.array(F.lit(2), F.lit(3)))
    assert one(spark, column, s=[["a"], [], ["b"], ["c"]]) == [1, 2]


def test_unescape_title(spark):
    assert one(spark, T.unescape_title(F.col("t")), t="C%2B%2B_a+b") == "C++ a+b"
    assert one(spark, T.unescape_title(F.col("t")), t="50%") == "50%"


def test_char_ids(spark):
    ids = one(spark, T.char_ids(F.col("t")), t="ab")
    assert len(ids) == 50 and ids[:4] == [259, 98, 99, 260] and set(ids[4:]) == {261}
    assert len(one(spark, T.char_ids(F.col("t")), t="x" * 80)) == 50


def test_murmur3():
    # Published values of the 32-bit function with seed 0.
    assert P.murmur3_32(b"") == 0
    assert P.murmur3_32(b"hello") == 0x248BFA47
    assert P.murmur3_32(b"hello, world") == 0x149BBB7F


def test_token_spans_in_small_batches(spark, monkeypatch):
    """A batch of rows goes back in pieces of bounded text, whatever the texts' length."""
    monkeypatch.setattr(P, "SLICE", 8)
    texts = pa.array(["ab, c", None, "", "a longer text than a slice", "x", "y z"])
    assert list(P._slices(texts)) == [(0, 3), (3, 1), (4, 2)]
    frame = spark.createDataFrame(list(enumerate(texts.to_pylist())), "i int, t string").coalesce(1)
    whole = frame.select("i", P.token_spans(F.col("t")).alias("s")).collect()
    assert sorted(P.with_token_spans(frame, "t", "s").collect()) == sorted(whole)
    assert [len(r.s) for r in sorted(whole)] == [3, 0, 0, 6, 1, 2]


def test_token_spans(spark):
    spans = one(spark, P.token_spans(F.col("t")), t="ab, c")
    assert [(s.text, s.space, s.start, s.end) for s in spans] == [("ab", "ab", 0, 2), (",", ", ", 2, 3), ("c", "c", 4, 5)]


def test_token_spans_of_texts_without_tokens(spark, tmp_path):
    """As in SQL, a null text has no number of tokens, and a text without tokens no sum of characters."""
    texts = [None, "", " \n\u00a0", "ab, c", None, "\u00e9\U00010400 ."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.sql(registry.ORACLE_SQL["T05_token_spans"]).fetchall())
    assert want == [(0, None, None), (1, 0, None), (2, 0, None), (3, 3, 4), (4, None, None), (5, 2, 3)]
    assert sorted(map(tuple, registry.QUERIES["T05_token_spans"](spark, str(tmp_path)).collect())) == want


def test_nfd(spark):
    assert one(spark, P.nfd(F.col("t")), t="é") == unicodedata.normalize("NFD", "é")
    assert one(spark, P.strip_accents(F.col("t")), t="Éa") == "ea"


def test_ngrams_by_another_loop(spark):
    words = "the new york of and a the end . , new of york".split()
    drop = [w in T.STOPWORDS or w in ".," for w in words]
    rules = {None: lambda f: False, "any": any, "all": all, "ends": lambda f: f[0] or f[-1]}
    for mode, rule in rules.items():
        for n in (1, 2, 3):
            spans = [(i, i + k) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]
            want = [" ".join(words[a:b]) for a, b in spans if not rule(drop[a:b])]
            assert one(spark, T.ngrams(F.col("t"), n, mode=mode), t=words) == want


def test_postings_by_another_loop(spark):
    texts = {1: "The new York, new york", 2: "", 3: None, 4: "of the end", 5: "END end END end"}
    want = {}
    for d, t in texts.items():
        words = [w.lower() for w in re.findall(r"\w+|[^\w\s]", t or "")]
        for i, w in enumerate(words):
            for gram in (words[i : i + 1], words[i : i + 2]):
                if len(gram) == 2 or gram == [w]:
                    if not any(x in T.STOPWORDS or x == "," for x in gram) and (len(gram) == 1 or gram != [w]):
                        key = (d, " ".join(gram))
                        want[key] = want.get(key, 0) + 1
    # The last word has no pair, so its slice of two is a slice of one and isn't counted again.
    for d, t in texts.items():
        words = [w.lower() for w in re.findall(r"\w+|[^\w\s]", t or "")]
        if words and words[-1] not in T.STOPWORDS:
            want[(d, words[-1])] -= 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.term): r.tf for r in tfidf.postings(df).collect()} == want
    arrays = df.select("doc_id", F.explode(T.ngrams(T.tokens(F.col("text")), 2, True, "any")).alias("term")).groupBy("doc_id", "term").count()
    assert {(r.doc_id, r.term): r["count"] for r in arrays.collect()} == want


def test_whole_documents_by_another_loop(spark):
    """Decomposition, accents and buckets of every document or term, against the library's own functions."""
    from sparkweave.plans import python_queries as Q

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if unicodedata.combining(c) == 0)
    assert {r.doc_id: r.nfd for r in Q.T15_decompose(spark, data).collect()} == {d: digest(unicodedata.normalize("NFD", t)) for d, t in texts.items()}
    assert {r.doc_id: r.plain for r in Q.T18_strip_accents(spark, data).collect()} == {d: digest(plain(t)) for d, t in texts.items()}
    buckets = {r.term: r.bucket for r in Q.T16_hash_buckets(spark, data).collect()}
    assert len(buckets) > 1000 and all(0 <= b < 1 << 24 for b in buckets.values())
    assert all(buckets[t] == P.murmur3_32(t.encode()) % (1 << 24) for t in buckets)
