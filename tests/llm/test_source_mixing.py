import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkweave.llm import source_mixing as M

from .fixtures import awkward, empty, wider


def shares(totals, weights, period):
    weight = {s: (n**M.POWER if weights is None else weights.get(s, 0.0)) for s, n in totals.items()}
    total = sum(weight.values())
    return {s: max(1, int(w / total * period + 0.5)) for s, w in weight.items()}


def simulate(share):
    """Earliest deadline first over one period, as plainly as it can be said."""
    period, done, out = sum(share.values()), Counter(), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // w), s) for s, w in sorted(share.items()) if done[s] < w and done[s] * period // w <= t]
        s = min(ready)[1]
        out.append((s, done[s]))
        done[s] += 1
    return out


def documents(spark, sizes):
    rows = [(i * 100 + k, "x" * n, f"s{i}") for i, own in enumerate(sizes) for k, n in enumerate(own)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("weights", [None, {"s0": 0.5, "s1": 0.3, "s2": 0.2}, {"s0": 1.0}])
def test_schedule_is_the_simulation(spark, weights):
    docs = documents(spark, [[10] * 40, [10] * 20, [10] * 9])
    got = M.mix(docs, weights, block_units=10, period=64).collect()
    share = shares({"s0": 400, "s1": 200, "s2": 90}, weights, 64)
    order = simulate(share)
    at = {turn: i for i, turn in enumerate(order)}
    for r in got:
        cycle, turn = divmod(r.block, share[r.source_name])
        assert r.slot == cycle * len(order) + at[r.source_name, turn]
        assert r.release <= r.slot < r.deadline
    assert len({r.slot for r in got}) == len(got) == 69


def test_deviation_is_below_one_block(spark):
    weights = {"s0": 0.5, **{f"s{i}": 0.5 / 9 for i in range(1, 10)}}
    docs = documents(spark, [[10] * 90, *[[10] * 10] * 9])
    rows = M.mix(docs, weights, block_units=10, period=360).where("on_target").orderBy("slot").collect()
    have, period = Counter(), 360
    share = shares({f"s{i}": 1 for i in range(10)}, weights, period)
    for n, r in enumerate(rows, 1):
        assert r.slot == n - 1  # no gap while all sources last
        have[r.source_name] += 1
        assert all(abs(have[s] - n * w / sum(share.values())) < 1 for s, w in share.items())


def test_nothing_is_lost(spark):
    for rows in (awkward(spark), wider(awkward(spark))):
        placed = M.mix(rows, block_units=100)
        assert placed.count() == rows.count()
        assert M.mix(rows, block_units=100, whole_rows=False).count() == rows.count()
        ordered = M.in_mix_order(rows)
        assert ordered.columns == rows.columns
        assert sorted(map(str, ordered.collect())) == sorted(map(str, rows.collect()))


def test_order_of_files(spark, tmp_path):
    docs = documents(spark, [[10] * 40, [10] * 20, [10] * 9])
    slots = {r.row.doc_id: (r.slot, r.start) for r in M.mix(docs, block_units=30).collect()}
    M.in_mix_order(docs, block_units=30).write.parquet(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*.parquet"))
    ids = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert [slots[i] for i in ids] == sorted(slots.values())


def test_hot_source_is_numbered_in_groups(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("hot").alias("source"))
    starts = [r.start for r in M.mix(docs).collect()]
    assert sorted(starts) == list(range(0, 6000, 2))


def test_empty_table(spark):
    assert M.mix(empty(spark)).count() == 0 and M.in_mix_order(empty(spark)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = M.in_mix_order(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("weights", [{"s0": 0.6, "s1": 0.3995, "s2": 0.0005}, {"s0": 0.9999, "s1": 0.0001}])
def test_deviation_from_the_target_weights(spark, weights):
    """Over far more than one period, and with a source whose weight is 0."""
    sizes = [int(w * 9000) + 3 for w in weights.values()] + [3]
    names = [*weights, f"s{len(weights)}"]
    parts = [spark.range(n).selectExpr(f"id + {i}000000 as doc_id", "'xxxxxxxxxx' as text", f"'{s}' as source") for i, (s, n) in enumerate(zip(names, sizes))]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    rows = sorted((r.slot, r.release, r.deadline, r.source_name, r.on_target) for r in M.mix(docs, weights, block_units=10).collect())
    assert len({r[0] for r in rows}) == len(rows) == sum(sizes) and all(r[1] <= r[0] < r[2] for r in rows)
    have, ahead = Counter(), [r for r in rows if r[4]]
    for n, r in enumerate(ahead, 1):
        assert r[0] == n - 1
        have[r[3]] += 1
        assert all(abs(have[s] - n * w) < 1.001 for s, w in weights.items())
    assert len(ahead) > 8 * M.PERIOD and names[-1] not in have
