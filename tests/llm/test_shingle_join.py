import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import linkage as L
from sparkweave.llm import shingle_join as J

from .fixtures import awkward, empty, wider


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute(rows):
    """doc_id to (set size, component), from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for t in s:
            holders[t].append(i)
    for own in holders.values():
        shared.update((a, b) for a in own for b in own if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_components(docs).collect()}
    assert got == brute(rows)
    return got


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def altered(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = "".join(rng.choices("klmnop", k=5))
    return out


def test_groups_passages_and_chains(spark):
    """Copies, many near copies at and around the bound, a passage in most texts, chains, short texts."""
    rng = random.Random(7)
    passage, base, texts = words(rng, 60), words(rng, 150), []
    texts += [base] * 30
    texts += [altered(rng, base, rng.randint(1, 8)) for _ in range(120)]
    texts += [words(rng, 50) + passage + words(rng, 40) for _ in range(150)]
    texts += [passage] * 3 + [passage + words(rng, k) for k in range(1, 30)]
    chain = words(rng, 100)
    for _ in range(12):
        chain = altered(rng, chain, 2)
        texts.append(chain)
    texts += [words(rng, n) for n in range(9) for _ in range(3)]
    texts += [["a", "b", "c", "d"], ["A", "b", "C", "d"], [], ["a"]]
    rng.shuffle(texts)
    got = check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert max(Counter(c for _, c in got.values()).values()) > 60


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    """Even with every shared token frequent, and with frequent ones unknown, the result is the same."""
    rng = random.Random(11)
    base = words(rng, 90)
    rows = [(i, " ".join(altered(rng, base, rng.randint(0, 6)))) for i in range(60)] + [(100 + i, " ".join(words(rng, 30) + base[:40])) for i in range(20)]
    for frequent, known in ((1, 1 << 20), (10**9, 1 << 20), (2, 5)):
        monkeypatch.setattr(J, "FREQUENT", frequent)
        monkeypatch.setattr(J, "FREQUENT_KNOWN", known)
        check(spark, rows)


def test_small_rounds(spark, monkeypatch):
    monkeypatch.setattr(L, "PIVOTS", 2)
    monkeypatch.setattr(L, "PACK", 4)
    monkeypatch.setattr(L, "QUICK_ROUNDS", 1)
    rng = random.Random(3)
    base = words(rng, 80)
    check(spark, [(i, " ".join(altered(rng, base, rng.randint(0, 9)))) for i in range(40)])


@settings(max_examples=200, deadline=None)
@given(data=st.data(), n=st.integers(1, 120), seed=st.integers(0, 10**6), often=st.floats(0, 1))
def test_similar_sets_share_a_key(data, n, seed, often):
    """Any two sets at the bound or above meet under at least one key, whichever tokens are frequent."""
    rng = random.Random(seed)
    a = set(rng.sample(range(10_000), n))
    b = set(a)
    for _ in range(data.draw(st.integers(0, max(1, n // 5)))):
        if rng.random() < 0.5 and len(b) > 1:
            b.discard(rng.choice(sorted(b)))
        else:
            b.add(rng.randrange(10_000, 20_000))
    pool = sorted(a | b)
    common = J._mix(np.array(rng.sample(pool, int(often * len(pool))), np.uint64))
    known = np.sort(common)
    x, y = (np.sort(J._mix(np.array(sorted(s), np.uint64))) for s in (a, b))
    if 100 * len(a & b) < 80 * len(a | b):
        return
    assert J.may_be_similar(x[: len(x) // 4 + 1], len(x), y[: len(y) // 4 + 1], len(y))
    assert len(np.intersect1d(J.index_keys(x, len(x), known), J.index_keys(y, len(y), known)))
    bits = np.bitwise_xor(L.parity_bits(x), L.parity_bits(y)).view(np.uint64)
    assert sum(int(v).bit_count() for v in bits) <= len(a ^ b)


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_documents(spark, change):
    got = J.join_components(change(awkward(spark))).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(
        (str(i), *brute([(r.doc_id, r.text) for r in awkward(spark).collect() if r.doc_id is not None])[i])
        for i in (r.doc_id for r in awkward(spark).collect())
        if i is not None
    )
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_one_of_each(spark):
    rows = wider(awkward(spark))
    kept = J.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "9", "10", "11", "None"])


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_that_share_a_doc_id(spark, turn):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(5, b), (5, a), (9, a + " x"), (11, b + " y"), (20, c), (20, c), (21, c + " z"), (22, ""), (22, "")][::turn]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = J.join_components(docs).collect()
    got = {(r.doc_id, r.component_id) for r in found}
    assert got == {(5, 5), (9, 5), (11, 5), (20, 20), (21, 20), (22, 22)} and len(found) == len(rows)
    # Texts that aren't alike all stay, though they share an id; equal rows don't.
    assert sorted(J.one_of_each(docs).collect()) == sorted([(5, a), (5, b), (20, c), (22, "")])


def test_links_of_all_rows_of_an_id_count(spark):
    rng = random.Random(6)
    a, b = (" ".join(words(rng, 40)) for _ in range(2))
    rows = [(3, a), (7, a + " x"), (7, b), (8, b + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in J.join_components(docs).collect()} == {3}
    assert {r.doc_id for r in J.one_of_each(docs).collect()} == {3, 7}


def test_empty_table(spark):
    assert J.join_components(empty(spark)).count() == 0 and J.one_of_each(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 9), (5, 5)], "a long, b long")
    got = {r.node: r.comp for r in L.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, 9: 5}


def test_words_are_split_by_ascii_white_space_alone():
    assert len(J.Shingler()("a b c d e\x0bf g\x1ch\u00a0i")) == 3
