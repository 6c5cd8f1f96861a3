"""Micro logs with values worked out by hand (FIXTURES.md, section 3)."""

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import compare, controlflow, detect, evaluate, experiments, grid
from shiftscope.schema import dense_index


def events(spark, traces):
    rows = [(t, i, a) for t, trace in enumerate(traces) for i, a in enumerate(trace)]
    return spark.createDataFrame(rows, "trace_idx long, event_idx int, activity string")


def cells(frame):
    return {(r.a1, r.a2): r.n for r in frame.collect()}


def histogram(spark, first, second):
    rows = [("d", 0, 9, str(i), a, b) for i, (a, b) in enumerate(zip(first, second, strict=True))]
    return spark.createDataFrame(rows, "detector string, k long, x_end long, value string, o1 long, o2 long")


def test_eventually_follows(spark):
    found = cells(controlflow.causality_counts(events(spark, ["abc", "acb"])))
    assert {k: n for k, n in found.items() if n} == {("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 1, ("c", "b"): 1}
    assert set(found) == {(x, y) for x in "abc" for y in "abc"}
    back = cells(controlflow.causality_counts(events(spark, ["abc", "acb"]), "preceded_by"))
    assert back == {(y, x): n for (x, y), n in found.items()}


def test_margins(spark):
    assert cells(controlflow.causality_counts(events(spark, ["ab"]))) == {("a", "a"): 0, ("a", "b"): 1}


def test_entropy(spark):
    found = {r.activity: r.entropy for r in controlflow.relational_entropy(events(spark, ["abc", "acb"])).collect()}
    assert found == pytest.approx({"a": 0.9182958, "b": 0.9182958, "c": 0.9182958})


def test_concurrency_and_runs(spark):
    log = events(spark, ["abc", "acb"])
    assert {(r.a1, r.a2) for r in controlflow.concurrency(log).collect()} == {("b", "c"), ("c", "b")}
    assert {r.run for r in controlflow.runs(log).collect()} == {"a>b;a>c;b>c;c>b"}
    assert [r.run for r in controlflow.runs(events(spark, ["a"])).collect()] == [""]


@pytest.mark.parametrize(
    ("test", "first", "second", "statistic", "p"),
    [
        (compare.g_test, (10, 10, 10), (15, 10, 5), 2.7057660, 0.2584939),
        (compare.chi_squared, (10, 10, 10), (15, 10, 5), 2.6666667, 0.2635971),
        (compare.chi_squared, (10, 20), (20, 10), 5.4, 0.0201368),
        (compare.g_test, (10, 20), (20, 10), 5.4840650, 0.0191906),
        (compare.g_test, (7,), (9,), 0.0, 1.0),
    ],
)
def test_contingency(spark, test, first, second, statistic, p):
    found = test(histogram(spark, first, second)).first()
    assert found.statistic == pytest.approx(statistic, abs=1e-6) and found.value == pytest.approx(p, abs=1e-6)


def test_small_expected(spark):
    assert compare.g_test(histogram(spark, (2, 10), (1, 12))).first().value is None
    assert compare.g_test(histogram(spark, (2, 10), (1, 12)), 0).first().value is not None


def test_hellinger(spark):
    assert compare.hellinger(histogram(spark, (10, 10, 10), (15, 10, 5))).first().value == pytest.approx(0.8492813, abs=1e-6)


def test_kolmogorov_smirnov(spark):
    rows = [("d", 0, 9, float(v), int(v <= 4), int(v >= 3)) for v in range(1, 7)]
    found = compare.ks_test(spark.createDataFrame(rows, "detector string, k long, x_end long, value double, o1 long, o2 long")).first()
    assert found.statistic == pytest.approx(0.5) and found.value == pytest.approx(0.7714286, abs=1e-6)
    assert compare.ks_p_unequal(0.5, 4, 4) == pytest.approx(0.7714286, abs=1e-6)


def test_streaks(spark):
    rows = [("d", i, i, 0.01 if x else 0.9) for i, x in enumerate((0, 1, 1, 0, 1, 1, 0, 0, 1))]
    series = spark.createDataFrame(rows, "detector string, pos long, x_end long, value double")
    assert [r.change_point for r in detect.change_points(series, 0.05, 3, 1).collect()] == [1]
    assert detect.change_points(series, 0.05, 3, 0).collect() == []


def test_grids(spark):
    regions = grid.region_grid(detect.tenths(spark, 10_000), 10_000, 200, 300, slide=10).agg(F.count(F.lit(1)), F.min("b_end"), F.max("b_end")).first()
    assert tuple(regions) == (549, 700, 9300)
    two = spark.createDataFrame([(500,), (700,)], "change_point long")
    assert grid.region_grid(two, 2000, 100, 300, slide=10).count() == 81
    one = spark.createDataFrame([(100,)], "change_point long")
    assert [r.b_end for r in grid.region_grid(one, 10_000, 200, 300, slide=10).collect()] == [399]
    assert grid.fixed_grid(spark, 10_000, 200, slide=10).count() == 961
    assert experiments.config_grid(spark, ["fixed", "adaptive"], [100, 150, 200], [0.05], [300], [10, 20], [0.1, 0.2, 0.3], [0.1]).count() == 36


def test_explanations(spark):
    primary = spark.createDataFrame([(1000,), (2000,)], "change_point long")
    secondary = spark.createDataFrame([("A", 950), ("A", 1200), ("B", 1050)], "detector string, change_point long")
    found = detect.explanations(primary, secondary, 300).orderBy("rank").collect()
    assert [(r.primary_cp, r.detector, r.lag) for r in found] == [(1000, "A", -50), (1000, "B", 50), (1000, "A", 200)]


def test_evaluation(spark):
    kind = "change_point long, detector string"
    r = evaluate.evaluate(spark.createDataFrame([(1000, "x"), (2000, "y")], kind), spark.createDataFrame([(990, "x"), (1010, "x"), (2500, "y")], kind), 200).first()
    assert (r.number_of_correct_detections, r.all_lags) == (1, [-10])
    assert (r.precision, r.recall, r.f1_score) == pytest.approx((1 / 3, 0.5, 0.4))
    r = evaluate.evaluate(spark.createDataFrame([(1000, "x"), (1100, "x")], kind), spark.createDataFrame([(1050, "x")], kind), 100).first()
    assert (r.number_of_correct_detections, r.precision, r.recall) == (2, 2.0, 1.0)


def test_positions_are_dense_and_ordered(spark):
    rows = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("v"))
    placed = dense_index(rows, [F.col("v")])
    assert placed.filter("v != trace_idx").count() == 0 and placed.count() == 5000


def test_hotelling_panes_against_rows(spark):
    rows = [("d", i, float((i * 37) % 23) if i % 11 else None, float((i * i) % 19) + 1000) for i in range(137)]
    rows = spark.createDataFrame(rows, "detector string, trace_idx long, x double, y double")
    windows = grid.fixed_grid(spark, 137, 40, slide=10)
    sides = [
        rows.join(windows, rows["trace_idx"].between(windows[f"{s}_start"], windows[f"{s}_end"])).select("detector", "k", F.col("b_end").alias("x_end"), F.lit(i).alias("side"), "x", "y")
        for i, s in ((1, "a"), (2, "b"))
    ]
    want = {r.k: (r.statistic, r.value) for r in compare.hotelling(sides[0].unionAll(sides[1]), ["x", "y"]).collect()}
    got = {r.k: (r.statistic, r.value) for r in compare.hotelling_panes(rows, windows, ["x", "y"], 10).collect()}
    assert len(want) == 6 and set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


@pytest.mark.parametrize(("name", "sf"), [("hotelling_series", "sf0.001"), ("runs_change_series", "sf0.01")])
def test_series_slide_by_ten(spark, name, sf):
    from shiftscope.plans import queries

    ends = sorted(r.x_end for r in queries.queries()[name](spark, f"/root/testdata/{sf}").select("x_end").collect())
    assert len(ends) > 1 and ends == list(range(399, ends[-1] + 1, 10))


def test_explanations_of_all_points(spark):
    from shiftscope.plans import queries

    found = queries.explanations_all_points(spark, "/root/testdata/sf0.01").select("primary_cp").distinct().count()
    assert found == 9
