"""Operator 3: quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and keeps what it measured and one failure bit a
rule. ``apply_policy`` turns bits into a verdict under a versioned policy, a mask of
the bits that reject. ``ablation`` aggregates the bits: what each rule rejects, what
it alone rejects, and what would be kept without it.

Repeated windows of five words are found inside each row by sorting 64-bit hashes of
the windows, so no text is shuffled and the cost is n log n in a text's words; two
different windows of one text share a hash with odds of about n^2 / 2^65.

Cases: a null text counts as empty, has no words and is rejected; equal rows give
equal rows; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import let

WORD_BREAK, WINDOW = r"[\x20\x09-\x0D]+", 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """Every rule over the measured columns; a rule's bit is its place here and never changes.

    Bounds are the usual ones of public web-text filters: symbols at most a tenth of
    the words, repeated lines at most three tenths of the lines, mean word length.
    """
    c = F.col
    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
        Rule("long_words", c("word_chars") > 20 * c("n_words")),
        Rule("shouting", 10 * c("n_upper") > 3 * c("word_chars")),
        Rule("echoed_words", 10 * c("n_echo_words") > 2 * c("n_words")),
    ]


#: Masks of the rules that reject, by version. A version never changes. The current one
#: leaves repeated lines to line dedup, which can remove them and keep the document.
BASE_MASK = 0b11
POLICIES = {"v1": 0b00111111, "v2": 0b11111111, "v3": 0b11110111}
CURRENT = "v3"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of five found twice or more in the text."""
    size = F.size(words)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            kept = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, n: a + n)

        return let(let(ordered, positions), total)

    def windows(hashed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashed) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]),
        )

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(size < WINDOW, 0).otherwise(let(let(hashed, windows), count))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and all measurements of its text, each counted once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long = lambda c: c.cast("long")

    def of_words(words: Column) -> Column:
        echoes = F.transform(words, lambda w, i: F.coalesce((F.get(words, i - 1) == w).cast("int"), F.lit(0)))
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.char_length(F.array_join(words, ""))).alias("word_chars"),
            long(_repeat_words(words)).alias("n_repeat_words"),
            long(F.aggregate(echoes, F.lit(0), lambda a, n: a + n)).alias("n_echo_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        )

    words = F.array_remove(F.split(text, WORD_BREAK), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = docs.select(
        "doc_id",
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
    )
    return found.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper",
        "w.n_echo_words",
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``, bit i set where rule i fails."""
    bits = [F.when(r.fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total)


def apply_policy(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """base_failed and kept; a row that fails a base rule is never kept."""
    bits = F.col("fail_bits")
    return (
        ledger_rows.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE_MASK)) != 0)
        .withColumn("kept", bits.bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0)
        .withColumn("policy", F.lit(version))
    )


def ablation(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """A row for each rule of the policy: rows that fail it, rows that fail it alone, rows kept without it.

    One pass over the bits: the ledger is counted by its distinct bit patterns first,
    of which there are at most two to the number of rules.
    """
    mask = POLICIES[version] | BASE_MASK
    patterns = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [(i, r.name) for i, r in enumerate(rules()) if mask >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in names]))
    rows = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    when = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy("rule", "bit").agg(
        when(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        when(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        when(rest == 0).alias("n_kept_without"),
    )


def quality_rules(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    return apply_policy(ledger(docs), version)


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The ledger is computed on the row itself, so nothing is joined or shuffled.
    """
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))
    carried = row.select(F.col("row").alias("doc_id"), "text")
    return quality_rules(carried, version).filter("kept").select("doc_id.*")
