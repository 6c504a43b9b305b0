"""Retrieval for a stream of questions against a fixed index.

Each micro-batch is ranked as a batch of its own, so the ranking, which a stream
can't order across batches, is the same plan as for a table of questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import tfidf


def answer_stream(questions: DataFrame, index: DataFrame, corpus: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write (qid, doc_id, score, rank) of each question to ``path``.

    ``questions``: a stream of (qid, text). A batch that is run again after a failure
    replaces its own folder, so that each question is answered once.
    """

    def write(batch: DataFrame, number: int) -> None:
        asked = tfidf.postings(batch, "qid")
        top = tfidf.top_k(tfidf.scores(asked, index, corpus), k)
        top.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
