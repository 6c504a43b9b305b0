import random
import re
from collections import Counter

import pytest

from sparkweave.llm import license_scan as S
from sparkweave.llm.license_templates import TEMPLATES

from .fixtures import PROSE, awkward, empty, wider


@pytest.fixture(scope="module")
def scan():
    return S.Scanner()


def dice(a, b):
    bigrams = lambda t: Counter(zip(w := re.findall(r"[^\W_]+", t.lower()), w[1:]))
    x, y = bigrams(a), bigrams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


@pytest.mark.parametrize("name, text", TEMPLATES)
def test_each_template_is_found_in_prose(scan, name, text):
    for body in (text, text.upper(), text.replace("\n", " ")):
        full = f"{PROSE}\n{body}\n{PROSE}"
        found = scan(full)
        assert name in [m[2] for m in found]
        best = max(found, key=lambda m: m[3])
        assert best[3] >= 0.95 and dice(full[best[0] : best[1]], text) >= 0.95


def test_altered_and_wrapped(scan):
    text = TEMPLATES[0][1].replace("hereby ", "").replace("without restriction, ", "")
    words = text.split()
    wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    (match,) = scan(f"Copyright 2020 someone\n\n{wrapped}\n")
    assert match[2] == "MIT" and 0.9 < match[3] < 1


def test_the_nearest_notice_wins(scan):
    assert [m[2] for m in scan("Licensed under CC BY 4.0.\nSome words.\nLicensed under CC BY-NC 4.0.")] == ["CC-BY-4.0", "CC-BY-NC-4.0"]
    assert [m[2] for m in scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]


def test_clean_text(scan):
    assert scan(PROSE) == [] and scan("The licence of the poet is his own. Under the license, he is free.") == []


def test_size_bounds_prune_nothing_that_matches(scan):
    """Each run of sentences that reaches the bound, by trying all, is covered by a match."""
    texts = [t for _, t in TEMPLATES if len(t) < 120]
    doc = "\n".join([PROSE, texts[0], "In between.", texts[5], texts[7][:-12], PROSE])
    found = scan(doc)
    lines = doc.split("\n")
    for i in range(len(lines)):
        for _, template in TEMPLATES:
            if len(lines[i].split()) > 1 and dice(lines[i], template) >= 0.8:
                at = doc.index(lines[i])
                assert any(a < at + len(lines[i]) and at < b for a, b, *_ in found)


@pytest.mark.parametrize(
    "before, notice, after, name",
    [
        ("Copyright 2020 Jane Doe, ", "licensed under the MIT License", ".", "MIT"),
        ("The code is ", "released under the MIT License", " and may be copied freely.", "MIT"),
        ("Some plain words before it ", "released under the MIT License", "", "MIT"),
        ("plain words without an end " * 50, TEMPLATES[0][1], " and on it goes" * 50, "MIT"),
    ],
)
def test_notice_within_a_sentence(scan, before, notice, after, name):
    a = len(before)
    assert scan(before + notice + after) == [(a, a + len(notice.rstrip(".")), name, 1.0)]


NOTICE = (
    "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by "
    "the Free Software Foundation{} either version {} of the License, or (at your option) any later version. This program is distributed in "
    "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {} Public License for more details. You should have received a copy of the GNU {} Public License "
    "along with this program. If not, see <http://www.gnu.org/licenses/>."
)


@pytest.mark.parametrize(
    "text, name",
    [
        (NOTICE.format(";", "General", ";", "2", "General", "General"), "GPL-2.0"),
        (NOTICE.format(":", "Lesser General", ",", "2.1", "Lesser General", "Lesser General"), "LGPL-2.1"),
        (NOTICE.format(":", "Lesser General", ",", "3", "Lesser General", "Lesser General"), "LGPL-3.0"),
        (NOTICE.format(":", "Affero General", ",", "3", "Affero General", "Affero General"), "AGPL-3.0"),
        (NOTICE.format(":", "General", ",", "3", "General", "General"), "GPL-3.0"),
        ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
    ],
)
def test_the_right_licence_is_named(scan, text, name):
    assert {m[2] for m in scan(f"Some words before.\n{text}\nAnd after.")} == {name}


@pytest.mark.parametrize("name, text", TEMPLATES)
def test_each_template_names_its_licence(scan, name, text):
    assert [m[2:] for m in scan(text)] == [(name, 1.0)]


def test_each_run_of_words_is_tried():
    """Against all runs of words, the best first, on texts of few different words."""
    rng = random.Random(2)
    for _ in range(60):
        templates = [(f"t{i}", " ".join(rng.choices("abcd", k=rng.randint(3, 9)))) for i in range(3)]
        words = rng.choices("abcdx", k=40)
        runs = []
        for i, (_, t) in enumerate(templates):
            for a in range(len(words)):
                for b in range(a + 2, len(words) + 1):
                    d = dice(" ".join(words[a:b]), t)
                    if d >= 0.8:
                        runs.append((-d, -len(t), i, a, b))
        kept = []
        for d, _, i, a, b in sorted(runs):
            if all(b <= x or y <= a for x, y, *_ in kept):
                kept.append((a, b, f"t{i}", round(-d, 6)))
        assert S.Scanner(templates)(" ".join(words)) == [(2 * a, 2 * b - 1, n, d) for a, b, n, d in sorted(kept)]


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_documents(spark, change):
    got = S.license_scan(change(awkward(spark))).collect()
    assert len(got) == awkward(spark).count() and all(r.license is None and r.n_matches == 0 and r.licenses == [] for r in got)


def test_rows(spark):
    row = S.license_scan(spark.createDataFrame([(1, "Hi.\nReleased under the MIT License.\nBye.")], "doc_id long, text string")).first()
    assert (row.license, row.dice, row.n_matches, row.starts, row.ends) == ("MIT", 1.0, 1, [4], [34])
    assert S.license_scan(empty(spark)).count() == 0


def test_time_in_proportion_to_the_text():
    import time

    scan = S.Scanner()

    def took(n):
        text = " ".join(f"Part {i} of it is licensed under the MIT License." for i in range(n))
        began = time.process_time()
        assert len(scan(text)) == n
        return time.process_time() - began

    took(50)
    assert took(4000) < 20 * took(500)
