"""Answer, supporting-fact, ranking and classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..storage import saved

#: Answers that only match themselves.
GUARDED = ("yes", "no", "noanswer")


def answer_scores(rows: DataFrame, key: list[str], prediction: str, gold: str) -> DataFrame:
    """key, em, f1, prec, recall of each row, over the tokens of the normal forms as multisets.

    ``key`` identifies a row. The overlap sums, over tokens, the smaller of the two counts.
    """
    # An empty form has no token; splitting it would give one empty one.
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    norm = rows.select(*key, T.normalize_answer(F.col(prediction)).alias("p"), T.normalize_answer(F.col(gold)).alias("g"))
    guarded = (F.col("p") != F.col("g")) & (F.col("p").isin(*GUARDED) | F.col("g").isin(*GUARDED))
    met = norm.select(*key, (F.col("p") == F.col("g")).alias("same"), guarded.alias("guarded"), split(F.col("p")).alias("pt"), split(F.col("g")).alias("gt"))
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("pt").alias("ts")), F.struct(F.lit(0).alias("side"), F.col("gt").alias("ts")))
    tokens = met.where("not guarded").select(*key, F.explode(sides).alias("s")).select(*key, "s.side", F.explode("s.ts").alias("t"))
    counts = tokens.groupBy(*key, "t").agg(F.sum("side").alias("np"), F.sum(1 - F.col("side")).alias("ng"))
    shared = counts.groupBy(*key).agg(F.sum(F.least("np", "ng")).alias("n"))
    sized = met.select(*key, "same", F.size("pt").alias("size_p"), F.size("gt").alias("size_g")).join(shared, key, "left")
    sized = sized.withColumn("n", F.coalesce("n", F.lit(0)))
    prec, recall = F.col("n") / F.col("size_p"), F.col("n") / F.col("size_g")
    zero = lambda c: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(c)
    return sized.select(
        *key, F.col("same").cast("int").alias("em"), zero(2 * prec * recall / (prec + recall)).alias("f1"),
        zero(prec).alias("prec"), zero(recall).alias("recall"),
    )


def set_scores(predicted: Column, gold: Column) -> Column:
    """struct(em, f1, prec, recall) of two arrays as sets; both empty: em 1, the rest 0."""
    tp = F.size(F.array_intersect(predicted, gold))
    n_p, n_g = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    prec = F.when(n_p > 0, tp / n_p).otherwise(F.lit(0.0))
    recall = F.when(n_g > 0, tp / n_g).otherwise(F.lit(0.0))
    f1 = F.when(prec + recall > 0, 2 * prec * recall / (prec + recall)).otherwise(F.lit(0.0))
    em = ((tp == n_p) & (tp == n_g)).cast("int")
    return F.struct(em.alias("em"), f1.alias("f1"), prec.alias("prec"), recall.alias("recall"))


def binary_counts(rows: DataFrame, label: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """n, tp, fp, fn, precision, recall, f1, accuracy of each group."""
    count = lambda c: F.sum(c.cast("long"))
    sums = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), count(label & predicted).alias("tp"), count(~label & predicted).alias("fp"), count(label & ~predicted).alias("fn")
    )
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    six = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return sums.select(
        *(by or []), "n", "tp", "fp", "fn", six(p).alias("prec"), six(r).alias("recall"), six(2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"),
        F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 6).alias("accuracy"),
    )


def threshold_table(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """(score, pos, neg): labels at each distinct score; all that AUC and average precision need."""
    return rows.groupBy(score).agg(F.sum(label.cast("long")).alias("pos"), F.sum((~label).cast("long")).alias("neg"))


def running(table: DataFrame, score: str, columns: list[str]) -> DataFrame:
    """``up_<column>``: sums over rows of greater score, this one's left out, and the totals ``all_<column>``.

    Sums run within ranges of the score; the ranges' own sums, one row each, are added
    to them, so that no task holds all scores. The ranges come from a sample and so are
    saved: both uses must see the same ones.
    """
    ranged = saved(table.repartitionByRange(F.desc(score)).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(*[F.sum(c).alias(f"part_{c}") for c in columns])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    shifted = totals.select(
        "part", *[zero(F.sum(f"part_{c}").over(before)).alias(f"before_{c}") for c in columns],
        *[F.sum(f"part_{c}").over(every).alias(f"all_{c}") for c in columns],
    )
    own = W.partitionBy("part").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    inner = ranged.select("*", *[zero(F.sum(c).over(own)).alias(f"own_{c}") for c in columns])
    met = inner.join(F.broadcast(shifted), "part")  # a row for each shuffle partition
    return met.select(*table.columns, *[(F.col(f"own_{c}") + F.col(f"before_{c}")).alias(f"up_{c}") for c in columns], *[f"all_{c}" for c in columns])


def auc_and_precision(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """auc (ties count half) and average precision over distinct thresholds."""
    met = running(threshold_table(rows, score, label), score, ["pos", "neg"])
    pairs = F.sum(F.col("neg") * F.col("up_pos") + F.col("pos") * F.col("neg") / 2)
    seen_pos, seen = F.col("up_pos") + F.col("pos"), F.col("up_pos") + F.col("pos") + F.col("up_neg") + F.col("neg")
    return met.agg(
        F.round(pairs / (F.max("all_pos") * F.max("all_neg")), 6).alias("auc"),
        F.round(F.sum(F.col("pos") / F.col("all_pos") * seen_pos / seen), 6).alias("average_precision"),
    )


def kendall_tau(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """tau-b of each group from its pairs; for groups that are small by nature, as a question's candidates."""
    a = rows.select(group, F.col("ord").alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = rows.select(group, F.col("ord").alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    sign = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    pairs = a.join(b, group).where("i < j").select(group, sign.alias("s"), (F.col("x1") != F.col("x2")).alias("dx"), (F.col("y1") != F.col("y2")).alias("dy"))
    sums = pairs.groupBy(group).agg(F.sum("s").alias("s"), F.sum(F.col("dx").cast("long")).alias("nx"), F.sum(F.col("dy").cast("long")).alias("ny"))
    return sums.where("nx > 0 and ny > 0").select(group, F.round(F.col("s") / F.sqrt(F.col("nx").cast("double") * F.col("ny")), 6).alias("tau"))
