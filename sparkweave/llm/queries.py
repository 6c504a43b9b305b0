"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_pair_codec,
    compression_classifier,
    license_scan,
    line_dedup,
    media_columns,
    personal_data,
    quality_rules,
    shingle_join,
    source_mixing,
    token_counts,
)
from .frames import documents


def op1_byte_pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pair_codec.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "fail_bits", "n_lines", "n_upper", "n_echo_words",
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(documents(spark, sf_dir), whole_rows=False)
    return mixed.selectExpr("row.doc_id", "source_name", "units", "start", "block", "slot", "release", "deadline", "on_target")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_components(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = compression_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_classifier.classify(docs, model)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_pair_codec, op2_token_counts, op3_quality_rules, op4_source_mixing, op5_license_scan,
        op6_shingle_join, op7_line_dedup, op8_compression_classifier, op9_personal_data, op10_media_columns,
    )
}

#: The ledger of operator 3 in SQL; its words have no spaces, so that joined windows are equal only if their words are.
_RULES_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS often FROM p) q, range(5) r(k) WHERE often > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, coalesce(c.n, 0) AS n_repeat_words,
  len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(list_filter(list_zip(ws, ws[2:]), lambda z: z[1] = z[2])) AS n_echo_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
  + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
  + 64 * (10 * n_upper > 3 * word_chars)::BIGINT + 128 * (10 * n_echo_words > 2 * n_words)::BIGINT AS fail_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 247 = 0 AS kept,
  fail_bits, n_lines, n_upper, n_echo_words FROM b"""

#: The schedule of operator 4: earliest deadline first on the weights in steps of 2^-36, by recursion, as far as it is
#: simulated. Blocks beyond that, of sources that are far larger than their weight, are none in these tables.
_MIX_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source_name, greatest(1, length(coalesce(text, '')))::BIGINT AS units, md5(coalesce(doc_id::varchar, '')) AS k FROM documents),
n AS (SELECT doc_id, source_name, units, coalesce(sum(units) OVER (PARTITION BY source_name ORDER BY k, units ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
t AS (SELECT source_name, sum(units)::BIGINT AS total, ceil(sum(units) / 65536)::BIGINT AS blocks FROM d GROUP BY source_name),
w AS (SELECT source_name, blocks, greatest(1, round(pow(total, 0.7) / (SELECT sum(pow(total, 0.7)) FROM t) * 68719476736))::BIGINT AS share FROM t),
p AS (SELECT list(source_name ORDER BY source_name) AS names, list(share ORDER BY source_name) AS shares, list(blocks ORDER BY source_name) AS blocks, sum(share)::BIGINT AS q FROM w),
u AS (SELECT greatest(min(((blocks + 1) * q + share - 1) // share), least(max((blocks * q + share - 1) // share), 4 * sum(blocks)))::BIGINT AS until FROM w, (SELECT q FROM p)),
sim AS (SELECT 0::BIGINT AS tick, list_transform(shares, lambda s: 0::BIGINT) AS done, NULL::BIGINT AS pick, NULL::BIGINT AS block FROM p
  UNION ALL
  SELECT tick + 1, list_transform(list_zip(done, range(1, len(done) + 1)), lambda z: z[1] + (z[2] = coalesce(pick, 0))::BIGINT), pick, done[pick] FROM (
    SELECT tick, done, list_sort(list_filter(list_transform(range(1, len(shares) + 1), lambda j: CASE WHEN done[j] * q < (tick + 1) * shares[j]
      THEN {'due': ((done[j] + 1) * q + shares[j] - 1) // shares[j], 'j': j} END), lambda c: c IS NOT NULL))[1].j AS pick FROM sim, p, u WHERE tick < until)),
s AS (SELECT names[pick] AS source_name, block, tick - 1 AS slot, block >= blocks[pick] AS missing FROM sim, p WHERE pick IS NOT NULL),
dry AS (SELECT min(slot) AS dry FROM s WHERE missing)
SELECT doc_id, n.source_name, units, start, start // 65536 AS block, slot, block * q // share AS release, ((block + 1) * q + share - 1) // share AS deadline, slot < dry AS on_target
FROM n JOIN w USING (source_name) JOIN s ON s.source_name = n.source_name AND s.block = start // 65536, (SELECT q FROM p), dry"""

ORACLE_SQL = {"op3_quality_rules": _RULES_SQL, "op4_source_mixing": _MIX_SQL}
