"""Operator 4: mixing sources to target weights, in DataFrame functions only.

Each source's documents are dealt into blocks of about equal size, in the order of a
hash of their ids. Time runs in slots of one block. With a share of w slots in a
period of P, block k of a source may run from slot floor(k P / w) on and must run
before slot ceil((k + 1) P / w); of the blocks that may run, the one with the earliest
deadline does. As the shares of all sources fill the period, every deadline is met, so
that a source is never a whole block ahead of its weight or behind it. The schedule
is simulated in one row, over arrays of the sources and the slots, on the weights in
steps of 2^-36: as far as the corpus goes, rounding adds less than 0.001 of a block.

It is simulated until all sources with a weight have run out, or for SPAN times the
corpus if that comes first. What is left then, blocks of sources whose weight is tiny
for their size, follows by a period of PERIOD slots that repeats, in which each has a
slot at least. A source whose weight is 0 has slots only there. With a stated
``period`` all of the schedule is that period repeated, with shares rounded to it.

A source that runs out leaves its slots empty: nothing is dropped or repeated, and
``on_target`` marks the slots before the first source runs out, where the weights hold.

Cases: a null source counts as the source named ''; a null or empty text counts as one
unit, so every document has a place; rows that are equal get places next to each
other; a source without a stated weight comes last; if none has a weight, all have the same; an empty table
gives an empty table; further columns are carried along or ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import let, saved

#: Units are characters. Slots of a period before rounding; the power of a source's
#: size that is its weight where none is stated; rows of a group that is numbered in
#: one task; rows of a schedule that may be broadcast.
BLOCK_UNITS, PERIOD, POWER, GROUP_ROWS, BROADCAST_ROWS = 1 << 16, 1024, 0.7, 20_000, 50_000
#: Steps of an exact weight; slots simulated, in blocks of the corpus, at most; slots of one array.
EXACT, SPAN, PIECE = 1 << 36, 4, 1024


def _numbered(docs: DataFrame, digits: int) -> DataFrame:
    """``start``: units of the source before the document. A hot source is numbered in many groups.

    Groups are the leading digits of the id's hash, so that their order is the hash's.
    """
    group = F.substring("order_key", 1, digits).alias("group_key")
    rows = docs.select("*", group)
    sums = rows.groupBy("source_name", "group_key").agg(F.sum("units").alias("group_units"))
    before = W.partitionBy("source_name").orderBy("group_key").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "source_name", "group_key", F.coalesce(F.sum("group_units").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("source_name", "group_key").orderBy("order_key", "units", "text_key")
    start = F.col("offset") + F.coalesce(F.sum("units").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(offsets, ["source_name", "group_key"]).withColumn("start", start)


def schedule(totals: DataFrame, weights: dict[str, float] | None, block_units: int, period: int) -> DataFrame:
    """A row for each slot of one period: source_name, turn (of its source), slot, share, period, dry.

    ``dry`` is the first slot for which a source has no block left. The simulation runs
    over one array of sources, in one row; its size is that of the weights table.
    """
    if weights is None:
        weight = F.pow(F.col("total").cast("double"), POWER)
    else:
        stated = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.element_at(stated, F.col("source_name")).cast("double"), F.lit(0.0))
    named = F.struct("source_name", weight.alias("weight"), F.ceil(F.col("total") / block_units).cast("long").alias("blocks"))
    one = totals.groupBy().agg(F.sort_array(F.collect_list(named)).alias("sources"))
    # Each saved step is one row. Were it not saved, the optimizer would copy its
    # expressions into the lambdas below and compute them for each element.
    one = saved(one.withColumn("sum", F.aggregate("sources", F.lit(0.0), lambda a, s: a + s["weight"])))
    share = lambda s: F.greatest(F.lit(1), F.round(s["weight"] / F.col("sum") * period).cast("int"))
    one = one.withColumn("shares", F.transform("sources", share))
    one = saved(one.withColumn("period", F.aggregate("shares", F.lit(0), lambda a, s: a + s)))

    def step(state: Column, t: Column) -> Column:
        def candidate(w: Column, i: Column) -> Column:
            k = F.get(state["done"], i).cast("long")
            may = (k < w) & (k * F.col("period") < (t + 1) * w.cast("long"))
            due = F.ceil((k + 1) * F.col("period") / w)
            return F.when(may, F.struct(due.alias("due"), i.alias("i"), k.cast("int").alias("k")))

        pick = F.array_min(F.filter(F.transform("shares", candidate), lambda c: c.isNotNull()))
        done = F.transform(state["done"], lambda n, i: n + F.when(i == pick["i"], 1).otherwise(0))
        ran = F.concat(state["ran"], F.array(F.struct(pick["i"].alias("i"), pick["k"].alias("k"))))
        return F.struct(done.alias("done"), ran.alias("ran")).cast("struct<done:array<int>,ran:array<struct<i:int,k:int>>>")

    empty = F.expr("named_struct('done', transform(shares, x -> 0), 'ran', array())").cast(
        "struct<done:array<int>,ran:array<struct<i:int,k:int>>>"
    )
    one = saved(one.withColumn("ran", F.aggregate(F.sequence(F.lit(0), F.col("period") - 1), empty, step, lambda s: s["ran"])))

    def first_missing(s: Column, i: Column) -> Column:
        share = F.get(F.col("shares"), i)
        turn = F.struct(i.alias("i"), F.pmod(s["blocks"], share.cast("long")).cast("int").alias("k"))
        return F.floor(s["blocks"] / share) * F.col("period") + F.array_position("ran", turn) - 1

    one = one.withColumn("dry", F.array_min(F.transform("sources", first_missing)))
    slots = one.select("sources", "shares", "period", "dry", F.posexplode("ran").alias("slot", "r"))
    return slots.select(
        F.get("sources", F.col("r.i"))["source_name"].alias("source_name"), F.col("r.k").alias("turn"), "slot",
        F.get("shares", F.col("r.i")).alias("share"), "period", "dry",
    )


def _quotient(a: Column, b: Column) -> Column:
    """a div b of whole numbers; the double quotient of an exact multiple rounds to it."""
    return F.round((a - F.pmod(a, b)) / b).cast("long")


def exact_schedule(totals: DataFrame, weights: dict[str, float] | None, block_units: int) -> tuple[DataFrame, DataFrame]:
    """(source_name, block, at) of the simulated slots, and for each source: share, q (the sum of shares),
    base (its simulated blocks), ended (slots simulated) and dry; both saved."""
    if weights is None:
        weight = F.pow(F.col("total").cast("double"), POWER)
    else:
        stated = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.element_at(stated, F.col("source_name")).cast("double"), F.lit(0.0))
    named = F.struct("source_name", weight.alias("weight"), F.ceil(F.col("total") / block_units).cast("long").alias("blocks"))
    one = totals.groupBy().agg(F.sort_array(F.collect_list(named)).alias("sources"), F.sum(F.ceil(F.col("total") / block_units)).alias("all"))
    one = saved(one.withColumn("sum", F.aggregate("sources", F.lit(0.0), lambda a, s: a + s["weight"])))
    share = lambda s: F.when(F.col("sum") <= 0, F.lit(1)).when(
        s["weight"] > 0, F.greatest(F.lit(1), F.round(s["weight"] / F.col("sum") * EXACT))
    ).otherwise(F.lit(0)).cast("long")
    one = one.withColumn("shares", F.transform("sources", share))
    one = saved(one.withColumn("q", F.aggregate("shares", F.lit(0).cast("long"), lambda a, s: a + s)))
    due = lambda k, w: _quotient(k * F.col("q") + w - 1, w)
    ends = lambda more: F.transform("sources", lambda s, i: F.when(F.get("shares", i) > 0, due(s["blocks"] + more, F.get("shares", i))))
    # The first source runs out before the first of ends(1), the last before the last of ends(0).
    until = F.greatest(F.array_min(ends(1)), F.least(F.array_max(ends(0)), SPAN * F.col("all")))
    one = saved(one.withColumn("until", until))
    kind = "struct<done:array<long>,ran:array<struct<i:int,k:long>>>"

    def step(state: Column, t: Column) -> Column:
        def candidate(w: Column, i: Column) -> Column:
            k = F.get(state["done"], i)
            return F.when(k * F.col("q") < (t + 1) * w, F.struct(due(k + 1, w).alias("due"), i.alias("i"), k.alias("k")))

        pick = F.array_min(F.filter(F.transform("shares", candidate), lambda c: c.isNotNull()))
        run = lambda p: F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == p["i"], 1).otherwise(0)).alias("done"),
            F.concat(state["ran"], F.array(F.struct(p["i"].alias("i"), p["k"].alias("k")))).alias("ran"),
        ).cast(kind)
        return let(pick, run)

    def piece(state: Column, first: Column) -> Column:
        last = F.least(first + PIECE, F.col("until")) - 1
        start = F.struct(state["done"].alias("done"), F.array().cast("array<struct<i:int,k:long>>").alias("ran")).cast(kind)
        run = F.aggregate(F.sequence(first, last), start, step)
        add = lambda r: F.struct(r["done"].alias("done"), F.concat(state["pieces"], F.array(r["ran"])).alias("pieces")).cast(whole)
        return let(run, add)

    whole = "struct<done:array<long>,pieces:array<array<struct<i:int,k:long>>>>"
    empty = F.expr("named_struct('done', transform(shares, x -> 0L), 'pieces', array())").cast(whole)
    firsts = F.sequence(F.lit(0).cast("long"), F.col("until") - 1, F.lit(PIECE).cast("long"))
    one = saved(one.withColumn("ran", F.when(F.col("until") > 0, F.aggregate(firsts, empty, piece))))
    pieces = one.select("sources", F.posexplode("ran.pieces").alias("p", "piece"))
    flat = pieces.select("sources", "p", F.posexplode("piece").alias("s", "r"))
    source = F.get("sources", F.col("r.i"))
    slots = saved(flat.select(
        source["source_name"].alias("source_name"), F.col("r.k").alias("block"), (F.col("p").cast("long") * PIECE + F.col("s")).alias("at"),
        (F.col("r.k") >= source["blocks"]).alias("missing"),
    ))
    dry = slots.where("missing").agg(F.min("at").alias("dry"))
    each = one.select(F.posexplode("sources").alias("i", "s"), "shares", "q", "ran.done", "until")
    per = each.select(
        "s.source_name", F.get("shares", F.col("i")).alias("share"), "q", F.get("done", F.col("i")).alias("base"), F.col("until").alias("ended"),
    ).crossJoin(F.broadcast(dry))
    return slots.where("not missing").drop("missing"), saved(per)


def _placed_exactly(rows: DataFrame, weights: dict[str, float] | None, block_units: int) -> DataFrame:
    totals, digits = _totals(rows)
    slots, per = exact_schedule(totals, weights, block_units)
    tail = saved(schedule(totals, weights, block_units, PERIOD)).drop("dry")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    tail_shares = tail.where("turn = 0").select("source_name", F.col("share").cast("long").alias("tail_share"), F.col("period").cast("long").alias("tail_period"))
    per = per.join(tail_shares, "source_name")
    numbered = _numbered(rows, digits).withColumn("block", F.floor(F.col("start") / block_units))
    known = numbered.join(few(per), "source_name").join(few(slots), ["source_name", "block"], "left")
    past = F.col("block") - F.col("base")
    known = known.withColumn("turn", F.when(past >= 0, F.pmod(past, F.col("tail_share")).cast("int")))
    known = known.join(few(tail.select("source_name", "turn", F.col("slot").alias("tail_at"))), ["source_name", "turn"], "left")
    cycle = F.col("ended") + _quotient(past, F.col("tail_share")) * F.col("tail_period")
    turn, k, q, w = F.col("turn"), F.col("block"), F.col("q"), F.col("share")
    inside = past < 0
    done = known.select(
        "*",
        F.when(inside, F.col("at")).otherwise(cycle + F.col("tail_at")).alias("slot"),
        F.when(inside, _quotient(k * q, w)).otherwise(cycle + F.floor(turn * F.col("tail_period") / F.col("tail_share"))).alias("release"),
        F.when(inside, _quotient((k + 1) * q + w - 1, w))
        .otherwise(cycle + F.ceil((turn + 1) * F.col("tail_period") / F.col("tail_share")))
        .alias("deadline"),
    ).withColumn("on_target", F.col("slot") < F.col("dry"))
    return done.drop(
        "order_key", "text_key", "group_key", "offset", "turn", "at", "share", "q", "base", "ended", "dry", "tail_share", "tail_period", "tail_at"
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_units: int = BLOCK_UNITS,
    period: int | None = None,
    whole_rows: bool = True,
) -> DataFrame:
    """The documents' columns in ``row``, with source_name, units, start, block, slot, release, deadline, on_target.

    The order of the mix is that of (slot, start). Without ``whole_rows``, ``row`` holds
    the doc_id alone and no text is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct("*" if whole_rows else "doc_id").alias("row"),
        F.coalesce(F.col("source"), F.lit("")).alias("source_name"),
        F.greatest(F.lit(1), F.char_length(text)).cast("long").alias("units"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order_key"),
        F.xxhash64(text).alias("text_key"),
    )
    if period is None:
        return _placed_exactly(rows, weights, block_units)
    return _placed(rows, weights, block_units, period)


def _totals(rows: DataFrame) -> tuple[DataFrame, int]:
    """Units and rows of each source; the digits by which the largest is numbered."""
    totals = saved(rows.groupBy("source_name").agg(F.sum("units").alias("total"), F.count("*").alias("n")))
    largest = totals.agg(F.max("n")).first()[0] or 1
    return totals, max(2, math.ceil(math.log(largest / GROUP_ROWS, 16)) if largest > GROUP_ROWS else 2)


def _placed(rows: DataFrame, weights: dict[str, float] | None, block_units: int, period: int) -> DataFrame:
    totals, digits = _totals(rows)
    slots = saved(schedule(totals, weights, block_units, period))
    if slots.count() <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    numbered = _numbered(rows, digits).withColumn("block", F.floor(F.col("start") / block_units))
    # The share comes with the slots; a source's turn needs it first.
    shares = slots.where("turn = 0").select("source_name", "share")
    turned = numbered.join(shares, "source_name").withColumn("turn", F.pmod("block", F.col("share").cast("long")).cast("int"))
    placed = turned.drop("share").join(slots.withColumnRenamed("slot", "at"), ["source_name", "turn"])
    cycle = F.floor(F.col("block") / F.col("share")) * F.col("period")
    done = placed.select(
        "*",
        (cycle + F.col("at")).alias("slot"),
        (cycle + F.floor(F.col("turn") * F.col("period") / F.col("share"))).alias("release"),
        (cycle + F.ceil((F.col("turn") + 1) * F.col("period") / F.col("share"))).alias("deadline"),
    ).withColumn("on_target", F.col("slot") < F.col("dry"))
    return done.drop("order_key", "text_key", "group_key", "offset", "turn", "at", "share", "period", "dry")


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, block_units: int = BLOCK_UNITS) -> DataFrame:
    """The documents, with their columns, ordered by the mix: each partition, and so each file
    that is written, holds a run of the schedule."""
    return mix(docs, weights, block_units).orderBy("slot", "start").select("row.*")
