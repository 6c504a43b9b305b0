"""The corpus pipeline: documents in, token ids of the documents worth training on out.

Quality rules reject documents; line dedup removes repeated lines; of each group of
near-duplicates one document stays; the rest is put in the order of a mix of sources;
and what remains is encoded and decoded.

Cases: an empty table gives empty tables at each stage. A null or empty text fails the
quality rules, as does any without ten words. A row with a null doc_id keeps its lines
and is no near-duplicate of any. Rows that share a doc_id are documents of their own
where their texts differ; of rows equal in both, whose lines are changed alike, one
stays. Further columns, whatever their names, are carried to the last stage but one; a
very long text is read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import byte_pair_codec, line_dedup, quality_rules, shingle_join, source_mixing
from sparkweave.llm.frames import drop_saved, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; n_chars follows the new text."""
    kept = line_dedup.without_repeats(docs)
    return line_dedup.with_new_length(kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component."""
    return shingle_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that each hold a run of the mix's schedule."""
    return source_mixing.in_mix_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids."""
    return byte_pair_codec.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True
    )


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mixture),
    ("byte_pair_codec", tokens),
]

#: Merges, signatures and similarity can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each reading what the one before wrote, which then goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            drop_saved(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
