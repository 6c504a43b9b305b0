"""Best spans and answer detection over token rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words that an answer may skip, and marks cut from the ends of a word.
SKIPPED = ("a", "an", "the", "")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’´`_"


def best_span(tokens: DataFrame, group: list[str], bound: int | None = None, additive: bool = False) -> DataFrame:
    """(group, start, end, score): the span with the greatest product (or sum) of start and end scores.

    ``tokens``: group, pos, p_start, p_end. The end isn't before the start, and fewer
    than ``bound`` tokens after it. Each end meets the best start of its frame, the
    earliest of equals; of equal spans the one with the earliest end, then start stands.
    """
    order = W.partitionBy(*group).orderBy("pos")
    frame = order.rowsBetween(W.unboundedPreceding if bound is None else -(bound - 1), W.currentRow)
    met = tokens.withColumn("from", F.max(F.struct("p_start", (-F.col("pos")).alias("back"))).over(frame))
    score = F.col("from.p_start") + F.col("p_end") if additive else F.col("from.p_start") * F.col("p_end")
    met = met.withColumn("score", score)
    best = met.groupBy(*group).agg(F.max(F.struct("score", (-F.col("pos")).alias("back"), F.col("from.back").alias("start"))).alias("b"))
    return best.select(*group, (-F.col("b.start")).alias("start"), (-F.col("b.back")).alias("end"), F.col("b.score").alias("score"))


def disjoint_spans(spans: DataFrame, group: str, bound: int, n: int) -> DataFrame:
    """The n best spans of each group that don't overlap, chosen greedily; ``spans``: group, s, e, score.

    A group is one text's spans: they are sorted and walked within the row, each kept
    where it meets none of those kept before it.
    """
    kind = "array<struct<loss:double,s:int,e:int>>"
    short = spans.where((F.col("e") >= F.col("s")) & (F.col("e") - F.col("s") < bound))
    listed = short.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("loss"), "s", "e"))).alias("all"))

    def step(kept, span):
        free = F.forall(kept, lambda k: (k["s"] > span["e"]) | (k["e"] < span["s"]))
        return F.when((F.size(kept) < n) & free, F.concat(kept, F.array(span))).otherwise(kept)

    chosen = listed.select(group, F.posexplode(F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step)).alias("at", "x"))
    return chosen.select(group, "x.s", "x.e", (-F.col("x.loss")).alias("score"), (F.col("at") + 1).alias("rank"))


def find_answers(words: list[str], answers: list[list[str]]) -> list[tuple[int, int]]:
    """(start, end) of all matches, ends included; skipped words may stand between an answer's words."""
    plain = [w.lower().strip(MARKS) for w in words]
    # Places of the words that count: what stands between them may be skipped.
    places = [i for i, w in enumerate(plain) if w not in SKIPPED]
    solid = [plain[i] for i in places]
    found = set()
    for answer in answers:
        wanted = [w for w in (w.lower().strip(MARKS) for w in answer) if w not in SKIPPED]
        for at in range(len(solid) - len(wanted) + 1 if wanted else 0):
            if solid[at : at + len(wanted)] == wanted:
                found.add((places[at], places[at + len(wanted) - 1]))
    return sorted(found)


def answer_spans(rows: DataFrame, key: list[str], words: str, answers: str) -> DataFrame:
    """(key, start, end) of each answer in each row; ``answers`` is an array of arrays of words."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                at = row._asdict()
                out += [(*(at[k] for k in key), a, b) for a, b in find_answers(list(at[words]), [list(x) for x in at[answers]])]
            yield pd.DataFrame(out, columns=[*key, "start", "end"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", start int, end int"
    return rows.select(*key, words, answers).mapInPandas(run, schema)
