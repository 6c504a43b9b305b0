import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import personal_data as P

from .fixtures import awkward, empty, wider


def base(text):
    """The base kinds by their plain patterns."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        ds = [int(c) for c in digits(m)][::-1]
        if 14 <= len(ds) <= 19 and sum(ds[0::2] + [sum(divmod(2 * d, 10)) for d in ds[1::2]]) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], P.BASE.index(s[2])))


PIECES = ["a@b.c", "@", ".", "_", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "-", " ", "é", "x", "7", "\n", "000.000.000.0255", "bob@mail.example.com"]


@settings(max_examples=600, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(PIECES), st.text("0123456789.@+- ax_", max_size=6)), max_size=14))
def test_base_spans_are_the_patterns(parts):
    text = "".join(parts)
    assert sorted(P.base_spans(text), key=lambda s: (s[0], P.BASE.index(s[2]))) == base(text)
    assert [s[:3] for s in P.find_spans(text) if s[2] in P.BASE] == base(text)


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + "(" * 200_000, "@" * 200_000, "+1 " * 100_000])
def test_long_runs_are_linear(text):
    P.find_spans(text)


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB82WEST12345698765431")


def test_further_kinds_and_context():
    kinds = lambda t: [s[2] for s in P.find_spans(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("GB82 WEST 1234 5698 7654 31") == []
    assert kinds("his SSN is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 212-555-0199 now") == ["local_phone"] and kinds("items 212-555-0199 here") == []
    assert P.score("email a@b.c", 6, 11, "email") > P.score("example a@b.c", 8, 13, "email")


@pytest.mark.parametrize(
    "text, account",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
        ("DE89370400440532013000 EUR 500", "DE89370400440532013000"),
        ("to GB82 WEST 1234 5698 7654 32 UK", "GB82 WEST 1234 5698 7654 32"),
        ("UNDER NO12 OF THE LIST PAY DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
        ("NO93 8601 1117 947 BANK", "NO93 8601 1117 947"),
    ],
)
def test_account_among_capitals(text, account):
    a = text.index(account)
    assert [s[:3] for s in P.find_spans(text) if s[2] == "iban"] == [(a, a + len(account), "iban")]


def test_runs_that_are_no_account():
    assert list(P.accounts("DE89 3704 0044 0532 0130 00X and DE89 3704 0044 0532 0130 01 BIC")) == []
    P.find_spans("AB12 " * 60_000)


def test_redact():
    assert P.redact("to bob@x.org or +1 (017) 555-7713.") == "to [email] or [phone]."


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_documents(spark, change):
    got = P.personal_data(change(awkward(spark))).collect()
    assert len(got) == awkward(spark).count() and all(r.spans == "" and r.scores == [] for r in got)


def test_rows(spark):
    row = P.personal_data(spark.createDataFrame([(1, "é a@b.cd 1.2.3.4")], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.spans) == (1, 1, 0, 0, "email:2:8,ip:9:16")
    import hashlib

    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert P.personal_data(empty(spark)).count() == 0


def test_time_in_proportion_to_the_text():
    import time

    def took(n):
        text = " ".join(f"call 020 555 {i % 9000 + 1000} or write a{i}@b.example" for i in range(n))
        began = time.process_time()
        spans = P.find_spans(text)
        assert sum(s[2] == "email" for s in spans) == n and sum(s[2] == "local_phone" for s in spans) == 0
        return time.process_time() - began

    took(100)
    assert took(16000) < 20 * took(2000)


def test_added_spans_never_overlap_base_ones():
    rng = __import__("random").Random(4)
    pieces = ["a@b.example", "call 212 555 0187", "212-555-0187@x.example", "phone (212) 555-0187", "social 123-45-6789", "+1 212 555 0187", "1.2.3.4", "bank DE89370400440532013000", " ", "x"]
    for _ in range(300):
        text = " ".join(rng.choices(pieces, k=12))
        spans = P.find_spans(text)
        own = [s for s in spans if s[2] in P.BASE]
        assert [s[:3] for s in own] == P.base_spans(text) or sorted(s[:3] for s in own) == sorted(P.base_spans(text))
        more = [s for s in spans if s[2] not in P.BASE]
        assert not any(a < y and x < b for a, b, *_ in more for x, y, *_ in own)
        # Each span that was proposed and doesn't overlap stays if its words speak for it.
        for kind, pattern in (("ssn", P.SSN), ("local_phone", P.LOCAL_PHONE)):
            for m in pattern.finditer(text):
                free = not any(x < m.end() and m.start() < y for x, y, *_ in own)
                assert ((m.start(), m.end(), kind) in [s[:3] for s in more]) == (free and P.score(text, *m.span(), kind) >= P.ACCEPT)
