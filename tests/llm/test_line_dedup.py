import random

import numpy as np
import pytest
import xxhash

from sparkweave.llm import line_dedup as D
from sparkweave.llm import linkage

from .fixtures import awkward, empty, wider


def normal(line):
    return " ".join(line.lower().split())


def grams(line):
    return {line[i : i + D.CHARS] for i in range(max(1, len(line) - D.CHARS + 1))}


def brute(rows):
    """Lines to remove, (doc_id, text, number), by comparing all pairs of distinct lines that aren't blank."""
    rows = {(d, t) for d, t in rows if d is not None and t}
    lines = [((d, t, i), normal(x)) for d, t in rows for i, x in enumerate(t.split("\n")) if normal(x)]
    distinct = sorted({x for _, x in lines})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: grams(x) for x in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and 100 * len(sets[a] & sets[b]) >= D.BOUND * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    first = {}
    for at, x in lines:
        first[find(x)] = min(first.get(find(x), at), at, key=place)
    return {at for at, x in lines if first[find(x)] != at}


def signed_hash(text):
    n = xxhash.xxh64_intdigest(text, seed=42)  # as Spark's xxhash64
    return n - (1 << 64) if n >> 63 else n


def place(at):
    """The order of lines: by doc_id, then a hash of the text, then number."""
    return at[0], signed_hash(at[1]), at[2]


def numbers(removed):
    return {(d, i) for d, _, i in removed}


def sentence(rng, n=12):
    return " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 8))) for _ in range(n))


def removed(report):
    return {(r.doc_id, i) for r in report.collect() for i in r.removed}


def test_recall_at_the_bound():
    rng = random.Random(4)
    a, b = [], []
    while len(a) < 400:
        line = sentence(rng, 14)
        words = line.split()
        words[rng.randrange(14)] = "".join(rng.choices("pqrs", k=4))
        x, y = grams(line), grams(" ".join(words))
        if 0.8 <= len(x & y) / len(x | y):
            a.append(line)
            b.append(" ".join(words))
    assert (D.band_keys(a) == D.band_keys(b)).any(1).mean() >= 0.99
    other = [sentence(rng, 14) for _ in a]
    assert (D.band_keys(a) == D.band_keys(other)).any(1).mean() <= 0.02


@pytest.mark.parametrize("n", [5, 10, 16, 20, 25, 30, 40, 56, 80, 200])
def test_recall_by_length(n):
    rng = random.Random(n)
    a, b = [], []
    while len(a) < 600:
        line = "".join(rng.choices("abcdefghijklmnop ", k=n + D.CHARS - 1))
        cut = max(1, round(n * rng.choice((0.1, 0.15, 0.2))))
        other = rng.choice((line[:-cut], line[cut:], line[:-cut] + "z" * cut, line[: n // 2] + "z" + line[n // 2 + 1 :]))
        x, y = grams(line), grams(other)
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            a.append(line)
            b.append(other)
    assert (D.band_keys(a) == D.band_keys(b)).any(1).mean() >= 0.985


def test_exact_verdict():
    assert D.jaccard_reaches("a" * 20, "a" * 25) and D.jaccard_reaches("abc", "abc") and not D.jaccard_reaches("abcdefgh", "hgfedcba")
    rng = random.Random(9)
    for _ in range(100):
        a = sentence(rng, 8)
        b = a.replace(rng.choice(a.split()), "x", 1)
        x, y = grams(a), grams(b)
        assert D.jaccard_reaches(a, b) == (100 * len(x & y) >= 80 * len(x | y))


def test_first_line_stays(spark):
    rows = [(5, "the very same line of text"), (2, "x\nThe very same   line of text"), (9, "the very same line of text\nthe very same line of text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(D.line_report(docs)) == {(5, 0), (9, 0), (9, 1)}
    assert {r.doc_id: r.text for r in D.without_repeats(docs).collect()} == {2: "x\nThe very same   line of text"}
    assert {r.doc_id: r.text for r in D.without_repeats(docs, drop_empty=False).collect()}[9] == ""


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_documents(spark, change):
    rows = change(awkward(spark))
    report = D.line_report(rows)
    assert report.count() == rows.count()
    assert removed(report) == numbers(brute([(r.doc_id, r.text) for r in awkward(spark).collect()]))
    kept = D.with_new_length(D.without_repeats(rows))
    assert kept.columns == rows.columns and kept.schema["n_chars"].dataType == rows.schema["n_chars"].dataType
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 2 not in texts and texts[3] is None and texts[11] == "same line of five words\nother"


def test_many_lists_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BROADCAST_IDS", -1)
    rows = [(i, "one line that is found in many texts\n" + f"and {i} lines that are not at all {i * 7919}") for i in range(20)]
    assert len(removed(D.line_report(spark.createDataFrame(rows, "doc_id long, text string"))) & {(i, 0) for i in range(20)}) == 19


def test_lines_of_few_words(spark):
    chinese = "春天的风从南方吹过宽阔的河面带来了远处花园里的香气和孩子们的笑声让人想起许多年前的那个早晨"
    rows = [
        (1, f"All rights reserved.\nles.\n\n{chinese}\nab\n漢字"),
        (2, f"les.\nall  rights reserved.\n\n{chinese}\nAB\n漢\n----"),
        (3, f"{chinese}。\n漢字\n\nabc\n----\n \t"),
    ]
    got = removed(D.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == numbers(brute(rows)) == {(2, 0), (2, 1), (2, 3), (2, 4), (3, 0), (3, 1), (3, 4)}


def test_all_lines_against_all_pairs(spark):
    rng = random.Random(8)
    base = [sentence(rng, n) for n in (1, 2, 3, 20) for _ in range(10)]
    rows = []
    for d in range(60):
        lines = [rng.choice(base) if rng.random() < 0.6 else sentence(rng, rng.randint(1, 20)) for _ in range(4)]
        rows.append((d, "\n".join([*lines, "short one", "x", ""])))
    got, want = removed(D.line_report(spark.createDataFrame(rows, "doc_id long, text string"))), numbers(brute(rows))
    assert len(want) > 200 and len(got ^ want) <= 0.01 * len(want)
    assert not any(i == 6 for _, i in got)  # blank lines stay
    few = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert removed(D.line_report(awkward(spark))) == numbers(brute(few))


def test_empty_table(spark):
    assert D.line_report(empty(spark)).count() == 0 and D.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_that_share_a_doc_id(spark, turn):
    rows = [
        (1, "first line of the two texts here\nsecond line is unique to this very text"),
        (1, "a different opening of the other\nfirst line of the two texts here"),
        (2, "second line is unique to this very text\nand this is the end of it all"),
        (2, "and this is the end of it all"),
        (2, "and this is the end of it all"),
    ][::turn]
    gone = brute(rows)
    assert len(gone) == 3
    want = sorted("\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone) for d, t in rows)
    got = D.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), drop_empty=False)
    assert sorted(r.text for r in got.collect()) == want
    assert sum("second line is unique" in t for t in want) == 1


def test_lists_in_pieces_and_very_long_lines(spark, monkeypatch):
    monkeypatch.setattr(D, "PACK", 8)
    monkeypatch.setattr(linkage, "HELD", 64)
    rng = random.Random(3)
    body, long_body = sentence(rng, 60), sentence(rng, 2500)
    assert len(long_body) > D.LONG
    rows = [(i, f"{body} {i:03d}\n{sentence(rng, 8)}") for i in range(60)]
    rows += [(100 + i, f"{long_body} {i:03d}") for i in range(5)]
    got = removed(D.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == numbers(brute(rows)) and len(got) == 63


def test_block_lists_hold_all_keys(spark, monkeypatch):
    monkeypatch.setattr(linkage, "PACK", 4)
    monkeypatch.setattr(linkage, "HELD", 16)
    rng = random.Random(6)
    rows = sorted({(rng.choice((7, 8, 9, 7, 7, rng.randrange(200))), rng.randrange(1000)) for _ in range(400)})
    keys = np.array([k for k, _ in rows], np.int64)
    nodes = np.array([n for _, n in rows], np.int64)
    blocks = []
    for a in range(0, len(rows), 37):
        made = linkage.dealt(keys[a : a + 37], nodes[a : a + 37], 3)
        blocks += zip(made["part"].tolist(), made["keys"], made["nodes"])
    found = linkage.block_lists(spark.createDataFrame(blocks, linkage.BLOCKS)).collect()
    by_key = {k: frozenset(n for key, n in rows if key == k) for k, _ in rows}
    merged = {}
    for r in found:
        assert len(r.nodes) <= 4
        merged.setdefault(r.list_id, []).extend(r.nodes)
    assert {frozenset(n) for n in merged.values()} == {s for s in by_key.values() if len(s) > 1}


def test_groups_within_a_piece():
    rng = random.Random(2)
    base = [sentence(rng, 20) for _ in range(4)]
    lines = [x[: len(x) - rng.randrange(14)] for x in base for _ in range(8)]
    rng.shuffle(lines)
    assert [a.tolist() for a in D.code_sets(lines)] == [D.code_set(x).tolist() for x in lines]
    groups = D.groups_of(D.code_sets(lines))
    assert sorted(i for g in groups for i in g) == list(range(len(lines)))
    group_of = {i: n for n, g in enumerate(groups) for i in g}
    for i, x in enumerate(lines):
        for j, y in enumerate(lines):
            assert not D.jaccard_reaches(x, y) or group_of[i] == group_of[j]
    for g in groups:  # connected: each but the first has a similar one
        seen, rest = {g[0]}, set(g[1:])
        while rest:
            new = {j for j in rest if any(D.jaccard_reaches(lines[i], lines[j]) for i in seen)}
            assert new
            seen, rest = seen | new, rest - new


def test_normal_lines():
    text = " A  b\tC\n\n Σας ΟΔΟΣ\nİx\u00a0y\u2003z \nplain line"
    assert D.normal_lines(text) == [D.normal(x) for x in text.split("\n")]
    plain = "Two  words\nΑΣ\nΣΑΣ b\n x \ny"
    assert D.normal_lines(plain) == [D.normal(x) for x in plain.split("\n")]


def altered(rng, line, share):
    """The line with about so many of its words replaced."""
    return " ".join(sentence(rng, 1) if rng.random() < share else w for w in line.split())


def test_sketches_prove_only_dissimilar_lines_apart():
    rng = random.Random(7)
    lines = [x for n in (3, 4, 12, 40, 90) for base in [sentence(rng, n)] for x in (base, *(altered(rng, base, s) for s in (0.02, 0.05, 0.1, 0.2, 0.4)), sentence(rng, n))]
    sets = D.code_sets(lines)
    group = np.repeat(np.arange(len(lines) // 7), 7)
    n, bits = np.array(list(map(len, sets))), D.sketches(sets)
    kept = D.may_meet(group, n, bits)
    alike = [any(j != i and group[j] == group[i] and D.similar(sets[i], sets[j]) for j in range(len(lines))) for i in range(len(lines))]
    assert kept[alike].all() and sum(alike) > 8
    assert not kept[[k for k in range(6, len(lines), 7)]].any()  # lines of other words
    chunks = D.PAIRS
    try:
        D.PAIRS = 3
        assert (D.may_meet(group, n, bits) == kept).all()
    finally:
        D.PAIRS = chunks


def test_sketches_without_sets(monkeypatch):
    """Sizes and sketches as from the sets of the lines, though no set is made."""
    rng = random.Random(13)
    lines = [sentence(rng, n) for n in (1, 2, 3, 12, 40, 200) for _ in range(30)] + ["aaaaa", "a" * 40, "ab " * 99, "春天的风从南方吹过", "x" * D.LONG]
    rng.shuffle(lines)
    lines = [x for x in lines if len(x) >= D.CHARS]
    sets = D.code_sets(lines)
    want = list(map(len, sets)), D.sketches(sets).tolist()
    made = []
    monkeypatch.setattr(D, "code_sets", lambda texts: made.append(texts))
    for chunk, rows in ((D.CHUNK, D.CHUNK_LINES), (64, 512), (1 << 17, 7)):
        monkeypatch.setattr(D, "CHUNK", chunk)
        monkeypatch.setattr(D, "CHUNK_LINES", rows)
        n, bits = D.sketches_of(lines)
        assert (n.tolist(), bits.tolist()) == want
    assert not made and [len(x) for x in D.sketches_of([])] == [0, 0]


def test_empty_bins_filled_at_once(monkeypatch):
    """However many steps are taken together before, a bin gets the value of the first of its probes that is filled."""
    rng = random.Random(17)
    lines = ["abcde", "abcdef", *(sentence(rng, n) for n in (1, 2, 3, 5, 9, 30) for _ in range(9)), "abc"]
    table = []
    for steps, late in ((D.BINS, 1), (D.STEPS, D.LATE), (1, 3), (2, 1 << 20)):
        monkeypatch.setattr(D, "STEPS", steps)
        monkeypatch.setattr(D, "LATE", late)
        table.append(D.signatures(lines)[:, : D.STRIDE * (D.ROWS - 1) + D.BANDS])
    assert all((t == table[0]).all() for t in table)
    assert [(row >= 0).all() for row in table[0]] == [(row >= 0).any() for row in table[0]] == [len(x) >= D.CHARS for x in lines]


@pytest.mark.parametrize("few", [D.BROADCAST_IDS, 0])
def test_texts_of_lines_that_only_share_a_band_do_not_travel(spark, monkeypatch, few):
    """Lines of similarity 0.5 to 0.75 share bands; only those with a similar one are compared by their texts."""
    rng = random.Random(11)
    base = sentence(rng, 60)
    far = [altered(rng, base, 0.12) for _ in range(60)]
    near = [far[0] + " end", far[1] + " end"]
    rows = [(i, line) for i, line in enumerate([*far, *near, far[2], "x" * 5, "ab " * (D.LONG // 2)])]
    sent, under = [], D._under_heads
    monkeypatch.setattr(D, "BROADCAST_IDS", few)
    monkeypatch.setattr(D, "_under_heads", lambda members, lines: (sent.append((lines.columns, members.count())), under(members, lines))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, i) for r in D.line_report(docs).collect() for i in r.removed}
    assert got == numbers(brute(rows))
    sketched, texts = (sum(n for columns, n in sent if ("text" in columns) == own) for own in (False, True))
    assert 0 < texts < sketched / 2
