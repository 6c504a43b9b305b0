import re
from collections import Counter

import pytest

from sparkweave.llm import quality_rules as Q

from .fixtures import awkward, empty, wider


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_documents(spark, change):
    rows = awkward(spark)
    got = Q.quality_rules(change(rows)).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in got) == sorted((str(r.doc_id), *brute(r.text)) for r in rows.collect())
    assert all(not r.kept for r in got if r.base_failed)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in Q.quality_rules(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_overlapping_repeats(spark):
    texts = ["a b c d e f a b c d e f", "a a a a a a a a", "a b c d e x a b c d e a b c d e", "k " * 4 + "k"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in Q.measure(df).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_good_text_is_kept_and_bad_is_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    met = Q.quality_rules(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in met if r.quality == 1 and not r.base_failed], [r for r in met if r.quality == 0]
    assert all(r.kept for r in good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_ablation(spark):
    ledger = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (4,)], "fail_bits long")
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in Q.ablation(ledger).collect()}
    assert got["few_words"] == (2, 1, 2) and got["repeated_words"] == (2, 1, 2) and got["symbols"] == (2, 2, 3)


def test_policies_differ_by_mask_alone(spark):
    ledger = spark.createDataFrame([(8,)], "fail_bits long")
    assert not Q.apply_policy(ledger, "v2").first().kept and Q.apply_policy(ledger, "v3").first().kept


def test_keep_good_carries_all_columns(spark):
    rows = wider(awkward(spark))
    kept = Q.keep_good(rows)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in Q.quality_rules(rows).where("kept").collect())


def test_empty_table(spark):
    assert Q.quality_rules(empty(spark)).count() == 0 and Q.keep_good(empty(spark)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = Q.quality_rules(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
