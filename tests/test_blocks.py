"""Windows as sums of panes by blocks, against the same windows counted one by one."""

import random

import numpy as np
import pytest

from shiftscope.operators import blocks, grid, histogram

VALUES = "detector string, trace_idx long, value string"


def one_by_one(rows, pairs):
    want = {}
    for p in pairs:
        for d, t, v in rows:
            for side, (a, b) in enumerate(((p.a_start, p.a_end), (p.b_start, p.b_end))):
                if a <= t <= b:
                    want.setdefault((d, p.k, p.b_end, v), [0, 0])[side] += 1
    return want


@pytest.mark.parametrize("offset", [20, 60])
def test_paired_panes_by_blocks(spark, monkeypatch, offset):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PARTITION_WINDOWS", 2)
    rng = random.Random(4)
    rows = [(d, t, rng.choice(["x", "y", None]) if d == "few" else f"v{rng.randrange(400)}") for d in ("few", "many") for t in range(500) if t % 90 > 25]
    values, pairs = spark.createDataFrame(rows, VALUES), grid.fixed_grid(spark, 500, 20, offset, 10)
    found = histogram.paired_counts(values, pairs, 10)
    assert {(r.detector, r.k, r.x_end, r.value): [r.o1, r.o2] for r in found.collect()} == one_by_one(rows, pairs.collect())
    # windows meet the panes within blocks: no join has a row for each pane of each window, and none is sent whole to all tasks
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert plan.count("Join ") == 1 and "Join LeftSemi" in plan


def test_many_windows_have_partitions_of_their_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PARTITION_WINDOWS", 2)
    rows = [("d", t, f"v{t % 3}") for t in range(800)]
    values, pairs = spark.createDataFrame(rows, VALUES), grid.fixed_grid(spark, 800, 20, slide=10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        found = histogram.paired_counts(values, pairs, 10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        held = found.groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("k").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # an adaptive plan would merge all of these rows into one partition, before the sums and after them
    assert sum(r.n for r in held) == 77 and len(held) > 20 and max(r.n for r in held) < 12
    # rows and windows are each moved once, and so are the sums
    assert plan.count(", 39), REPARTITION_BY_NUM") == 3


def test_many_windows_are_compared_in_partitions_of_their_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shiftscope.operators import compare, detect

    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PARTITION_WINDOWS", 2)
    rows = [(d, t, "late" if t >= 400 and t % 5 < 3 else f"v{t % 3}") for d in ("trace: first", "trace: second") for t in range(800)]
    values, pairs = spark.createDataFrame(rows, VALUES), grid.fixed_grid(spark, 800, 20, slide=10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        series = detect.change_series(values, pairs, lambda c: compare.g_test(c, 0), 10)
        held = series.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        points = detect.change_points(series, 0.05, 2)
        explained = detect.explanations(detect.tenths(spark, 800), points, keep_unexplained=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # the tests of windows stay where their sums were dealt; an adaptive plan would take all of them in one task
    assert sum(r.n for r in held) == 2 * 77 and len(held) > 20 and max(r.n for r in held) < 24
    assert {r.secondary_cp for r in explained if r.rank == 1 and r.primary_cp == 400} == {409} and len(explained) == 9 * 2


@pytest.mark.parametrize(("n_codes", "cells"), [(3, 1 << 20), (3, 16), (300, 64)])
def test_sums_of_windows(monkeypatch, n_codes, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = np.random.default_rng(6)
    codes, places, weights = rng.integers(0, n_codes, 300), rng.integers(-20, 90, 300), rng.integers(0, 4, 300)
    lows = rng.integers(-30, 95, 40)
    highs = lows + rng.integers(-1, 30, 40)
    window, code, (sums,) = blocks.sums_of(codes, n_codes, places, [weights], lows, highs)
    want = {}
    for w, (a, b) in enumerate(zip(lows, highs, strict=True)):
        for c, p, x in zip(codes, places, weights, strict=True):
            if a <= p <= b:
                want[w, int(c)] = want.get((w, int(c)), 0) + int(x)
    assert dict(zip(zip(window.tolist(), code.tolist(), strict=True), sums.tolist(), strict=True)) == want


def test_doubles_and_nested_values(spark):
    pairs = grid.fixed_grid(spark, 60, 20, slide=10)
    numbers = spark.createDataFrame([("d", t, [0.0, -0.0, float("nan"), None, 2.5][t % 5]) for t in range(60)], "detector string, trace_idx long, value double")
    own = {(r.k, str(r.value)): (r.o1, r.o2) for r in histogram.paired_counts(numbers, pairs, 10).collect()}
    assert own == {(k, v): (n, n) for k in range(3) for v, n in (("0.0", 8), ("nan", 4), ("None", 4), ("2.5", 4))}
    lists = spark.createDataFrame([("d", t, [t % 2]) for t in range(60)], "detector string, trace_idx long, value array<long>")
    assert {(r.k, r.value[0], r.o1, r.o2) for r in histogram.paired_counts(lists, pairs, 10).collect()} == {(k, v, 10, 10) for k in range(3) for v in (0, 1)}


def test_window_sums_of_panes(spark, monkeypatch):
    from shiftscope.operators import controlflow

    monkeypatch.setattr(blocks, "BLOCK", 4)
    # the last column is NULL where there is nothing to add
    rows = [(t // 5, "abc"[t % 3], t % 4, None if t % 6 == 0 else t) for t in range(200)]
    panes = spark.createDataFrame(rows, "pane long, activity string, occurs long, early long")
    windows = controlflow.window_panes(grid.fixed_grid(spark, 200, 20, slide=10), 5)
    found = controlflow.window_sums(panes, windows, ["activity"])
    want = {}
    for w in windows.collect():
        for p, a, x, y in rows:
            if w.w_start <= 5 * p <= w.w_end:
                own = want.setdefault((w.w_start, w.w_end, a), [0, 0])
                own[0] += x
                own[1] += y or 0
    assert {tuple(r)[:3]: list(r)[3:] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join LeftSemi" in plan
