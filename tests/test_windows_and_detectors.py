"""Adaptive windows against a plain model, streaks against a state machine, detectors, the explainer and experiments."""

import random

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import adaptive, compare, controlflow, detect, evaluate, experiments, explainer, grid, synth
from shiftscope.schema import Attribute

POINTS = "change_point long, detector string"


def model(values, size, slide, offset, least, regions=None):
    """{x_end: (place, first window, second window)}, walking as the operator's definition says."""
    out, now, before, last_end = {}, size, None, None
    for begin, end in regions or [(0, None)]:
        if last_end is not None and last_end > begin:
            begin = last_end
        else:
            now = size
        last_end, at = end, max(0, begin - 2 * now + 1)
        while True:
            x_end = at + offset + now - 1
            if x_end > len(values) - 1 or (end is not None and x_end > end):
                break
            a, b = values[at : at + now], values[at + offset : at + offset + now]
            out[x_end] = (out[x_end][0] if x_end in out else len(out), a, b)
            v = max(1, len(set(a + b)))
            if before is not None:
                now = max(least, round(now * v / before))
            before, at = v, at + slide
    return out


def found(counts):
    out = {}
    for r in counts.collect():
        out.setdefault((r.k, r.x_end), {})[r.value] = (r.o1, r.o2)
    return out


def expected(pairs):
    return {(k, x): {v: (a.count(v), b.count(v)) for v in {*a, *b}} for x, (k, a, b) in pairs.items()}


def log_of(spark, values):
    return spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "detector string, trace_idx long, value string")


def test_adaptive_sizes(spark):
    values = ["a"] * 8 + ["b", "c"] + ["a"] * 14
    pairs = model(values, 4, 2, 4, 2)
    assert {x: len(a) for x, (_, a, _) in pairs.items()} == {7: 4, 9: 4, 19: 12, 21: 12, 23: 12}
    assert found(adaptive.adaptive_counts(log_of(spark, values), 4, 2)) == expected(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_adaptive_against_model(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice(["a", "b", None] if (i // 60) % 2 else ["a", "c", "d", "e", "f"]) for i in range(400)]
    size, slide = rng.choice([(8, 2), (10, 3), (6, 6)])
    assert found(adaptive.adaptive_counts(log_of(spark, values), size, slide)) == expected(model(values, size, slide, size, 2))
    points = sorted(rng.sample(range(400), 4))
    regions = [(max(0, p - 40), p + 40) for p in points]
    cps = spark.createDataFrame([(p,) for p in points], "change_point long")
    own = adaptive.adaptive_counts(log_of(spark, values), size, slide, change_points=cps, max_distance=40)
    assert found(own) == expected(model(values, size, slide, size, 2, regions))


def test_adaptive_reach_is_refused_not_cut(spark):
    values = [str(i % 2) if i < 300 else str(i) for i in range(600)]
    cps = spark.createDataFrame([(310,), (560,)], "change_point long")
    with pytest.raises(Exception, match="raise reach"):
        adaptive.adaptive_counts(log_of(spark, values), 20, 5, change_points=cps, max_distance=200, reach=1).collect()


@pytest.mark.parametrize("block", [3, 65_536])
def test_streaks_against_state_machine(spark, monkeypatch, block):
    monkeypatch.setattr(detect, "BLOCK", block)
    rng = random.Random(11)
    rows, want = [], {}
    for d in range(12):
        low = [rng.random() < 0.55 for _ in range(40)]
        rows += [(str(d), i, 100 + i, 0.01 if x else rng.choice([0.9, None])) for i, x in enumerate(low)]
        for phi in (1, 2, 4):
            for rho in (0, 1, 3):
                points, streak, gap, first = [], 0, 0, None
                for i, x in enumerate(low):
                    if x:
                        first = i if streak == 0 else first
                        streak, gap = streak + 1, 0
                        points += [100 + first] if streak == phi else []
                    else:
                        gap += 1
                        streak = 0 if gap > rho else streak
                want[str(d), phi, rho] = points
    series = spark.createDataFrame(rows, "detector string, pos long, x_end long, value double")
    for phi in (1, 2, 4):
        for rho in (0, 1, 3):
            got = {}
            for r in detect.change_points(series, 0.05, phi, rho).collect():
                got.setdefault(r.detector, []).append(r.change_point)
            assert {d: sorted(p) for d, p in got.items()} == {d: want[d, phi, rho] for d in map(str, range(12)) if want[d, phi, rho]}


def test_streaks_may_end_with_a_region(spark):
    rows = [("d", i // 2, i, i, 0.01) for i in range(4)]
    series = spark.createDataFrame(rows, "detector string, region int, pos long, x_end long, value double")
    assert [r.change_point for r in detect.change_points(series, 0.05, 3).collect()] == [0]
    assert detect.change_points(series, 0.05, 3, reset_per_region=True).collect() == []


def drifting(spark, n=1200):
    rows = spark.range(n).withColumnRenamed("id", "trace_idx")
    kind = F.when((F.col("trace_idx") >= 600) & (F.col("trace_idx") % 5 < 4), "new").otherwise(F.concat(F.lit("v"), F.col("trace_idx") % 2))
    price = ((F.col("trace_idx") * 7919) % 101).cast("double") * F.when(F.col("trace_idx") >= 600, 3).otherwise(1)
    still = F.concat(F.lit("s"), F.col("trace_idx") % 3)
    return rows.select("trace_idx", kind.alias("kind"), price.alias("price"), still.alias("still"))


@pytest.mark.parametrize("windows", [explainer.Windows(60, 10), explainer.Windows(60, 10, adaptive=True)])
def test_explainer_over_mixed_attributes(spark, windows):
    log = explainer.EventLog(drifting(spark), 1200)
    attributes = [Attribute("kind", "trace", "categorical"), Attribute("still", "trace", "categorical"), Attribute("price", "trace", "continuous")]
    secondary = explainer.attribute_detectors(attributes, windows, explainer.Streaks(0.05, 3, 1))
    out = explainer.Explainer(explainer.KnownPoints([600]), [secondary]).explain(log, 100, timing=True)
    rows = out.table.collect()
    assert {r.detector for r in rows} >= {"trace: kind", "trace: price"} and "trace: still" not in {r.detector for r in rows}
    assert all(r.primary_cp == 600 and abs(r.lag) <= 100 for r in rows) and set(out.seconds) == {"primary", "secondary"}
    assert "trace: kind: 1 change points at" in out.secondary.summary()
    assert out.secondary.series.filter("x_end < 500 OR x_end > 700").count() == 0
    everywhere = explainer.Explainer(explainer.KnownPoints([600]), [secondary]).explain(log)
    assert everywhere.secondary.series.filter("x_end < 500").count() > 0
    with pytest.raises(ValueError, match="one name"):
        explainer.Explainer(explainer.KnownPoints([600]), [secondary, secondary]).explain(log)
    with pytest.raises(NotImplementedError):
        secondary.changes(log, unit="time")
    assert explainer.Changes(out.secondary.points.limit(0)).summary() == "no change points"


def test_continuous_region_against_rows(spark):
    """KS over the regions' single positions against the histogram of the same pairs."""
    values = drifting(spark).select(F.lit("d").alias("detector"), "trace_idx", F.col("price").alias("value"))
    pairs = grid.region_grid(spark.createDataFrame([(600,)], "change_point long"), 1200, 60, 100, slide=10)
    from shiftscope.operators.histogram import paired_counts, paired_rows

    one, two = (compare.ks_test(f(values, pairs)).orderBy("k").collect() for f in (paired_counts, paired_rows))
    assert one == two and len(one) == pairs.count()


def test_ks_with_nulls_and_unequal_sides(spark):
    rows = [("d", 0, 9, None, 1, 0), ("d", 0, 9, 1.0, 0, 1), ("d", 1, 10, 1.0, 2, 0), ("d", 1, 10, 2.0, 1, 1), ("d", 1, 10, 3.0, 0, 4)]
    got = {r.k: r for r in compare.ks_test(spark.createDataFrame(rows, "detector string, k long, x_end long, value double, o1 long, o2 long")).collect()}
    assert got[0].value is None and got[1].statistic == pytest.approx(0.8)
    assert got[1].value == pytest.approx(compare.ks_p_unequal(0.8, 3, 5))
    assert compare.ks_p_unequal(0.01, 11_000, 9_000) == pytest.approx(compare.ks_p_unequal(0.01, 11_000, 9_000, exact=None), abs=5e-3)


def test_control_flow_features(spark):
    traces = ["abc", "acb", "ab", "abcc"] * 6
    rows = [(t, i, a) for t, trace in enumerate(traces) for i, a in enumerate(trace)]
    events = spark.createDataFrame(rows, "trace_idx long, event_idx int, activity string")
    pairs = grid.fixed_grid(spark, 24, 8, slide=4)
    samples, columns = controlflow.feature_samples(events, pairs, "Relational Entropy")
    got = {(r.k, r.side): set() for r in samples.collect()}
    assert len(got) == 2 * pairs.count() and columns == ["entropy"]
    for r in samples.filter("k = 0 AND side = 1").collect():
        whole = {x.entropy for x in controlflow.relational_entropy(events.filter("trace_idx < 8")).collect()}
        assert any(r.entropy == pytest.approx(x) for x in whole)
    for feature in ("Runs", "Relational Entropy", "Relation Type Counts"):
        detector = explainer.ControlFlowDetector(feature, explainer.Windows(8, 4), explainer.Streaks(0.05, 1), 0)
        changes = detector.changes(explainer.EventLog(events.select("trace_idx").distinct(), 24, events))
        assert changes.series.count() == pairs.count() and changes.points.count() == 0
    with pytest.raises(ValueError):
        controlflow.feature_samples(events, pairs, "other")


def test_parts_and_times(spark):
    parts = detect.log_parts(103, 4, 10)
    assert parts == [(0, 24), (15, 50), (41, 76), (67, 102)]
    placed = detect.in_parts(spark, spark.range(103).withColumnRenamed("id", "trace_idx"), parts)
    assert placed.count() == 103 + 30 and placed.filter("part = 1 AND trace_idx = 15").first().part_idx == 0
    points = spark.createDataFrame([(0, 20), (1, 5), (2, 0)], "part int, change_point long")
    assert sorted(r.change_point for r in detect.absolute_points(spark, points, parts).collect()) == [20, 41]
    events = spark.createDataFrame([(20, 0, "t1"), (20, 1, "t2")], "trace_idx long, event_idx int, ts string")
    assert {r.change_point: r.ts for r in detect.timestamps(detect.absolute_points(spark, points, parts), events).collect()} == {20: "t1", 41: None}


def test_evaluation_far_from_each_other(spark):
    true = spark.createDataFrame([(1000, "x"), (5000, "y")], POINTS)
    none = spark.createDataFrame([], POINTS)
    r = evaluate.evaluate(true, none, 200).first()
    assert (r.number_of_correct_detections, r.precision, r.recall, r.f1_score, r.mean_lag, r.all_lags) == (0, None, 0.0, None, None, [])
    r = evaluate.evaluate_single(true, spark.createDataFrame([(1199, "z"), (4800, "q")], POINTS), 200).first()
    assert (r.number_of_correct_detections, r.precision, r.mean_lag) == (2, 1.0, -0.5)
    both = evaluate.evaluate(true, true, 0).withColumn("e", F.lit("a"))
    again = evaluate.aggregated(both.unionAll(both), ["e"]).first()
    assert again.all_lags == [0, 0, 0, 0] and again.number_experiments == 2 and again.f1_score == 1.0


def test_experiments_over_logs(spark, tmp_path):
    def values(shift):
        rows = spark.range(1000).withColumnRenamed("id", "trace_idx")
        kind = F.when((F.col("trace_idx") >= 500 + shift) & (F.col("trace_idx") % 5 < 4), "new").otherwise("old")
        return rows.select(F.lit("trace: relevant_attribute_01").alias("detector"), "trace_idx", kind.alias("value"))

    configs = [{"window_generator_type": k, "window_size": 50, "threshold": 0.05, "max_distance": 80, "slide_by": s, "proportional_phi": 0.2, "proportional_rho": 0.1} for k in ("fixed", "adaptive") for s in (5, 10)]
    true = lambda n: spark.createDataFrame([(500, "trace: relevant_attribute_01")], POINTS)
    logs = {"b.xes": (values(0), 1000), "a.xes": (values(1), 1000), "c.xes": (values(2), 1000)}
    out = experiments.experiments_over_logs(spark, logs, configs, "initial", f"{tmp_path}/results", true, fresh=True, limit=2)
    rows = out.collect()
    assert len(rows) == 8 and {r.config_event_log_file_path for r in rows} == {"a.xes", "b.xes"} and all(r.compute_time > 0 for r in rows)
    # adaptive windows double where the second value comes in, so what they find may lie beyond the tolerance
    assert all(r.number_of_correct_detections == len(r.all_lags) <= 1 and (r.config_window_generator_type == "adaptive" or r.all_lags) for r in rows)
    again = experiments.experiments_over_logs(spark, logs, configs[:1], "more", f"{tmp_path}/results", true, limit=1)
    assert again.count() == 9
    one = experiments.explain_config(values(0), 1000, detect.tenths(spark, 1000), configs[0]).collect()
    assert [r.primary_cp for r in one] == [500]


def test_exponential_fit():
    x = range(10)
    import math

    assert experiments.exponential_fit(list(x), [3 * math.exp(-0.4 * v) + 2 for v in x]) == pytest.approx((3, 0.4, 2), abs=1e-6)


def test_synthetic_plan(spark):
    drifts = synth.plan(3, [100, 200], relevant=3, irrelevant=2, k=4, kind="recurring", jitter=5.0)
    for d in drifts[:3]:
        assert abs(sum(d.base) - 1) < 1e-9 and abs(sum(d.drifted) - 1) < 1e-9 and d.change_point <= d.explains and d.length >= 1
    assert [d.explains for d in drifts] == [100, 200, 100, None, None]
    assert synth.drifted_pair(__import__("numpy").random.default_rng(1), 3, "new_distribution")[0].shape == (3,)
    base, other = (__import__("numpy").array(x) for x in synth.drifted_pair(__import__("numpy").random.default_rng(5), 3, "new_distribution"))
    assert synth.similarity_gap(base, other) >= synth.LEAST_DISTANCE
    made = synth.with_drifts(spark.range(4000).withColumnRenamed("id", "trace_idx"), synth.plan(1, [2000], relevant=1, irrelevant=0))
    name = "relevant_attribute_01"
    share = {(r.late, r[name]): r["count"] for r in made.groupBy((F.col("trace_idx") >= 2000).alias("late"), name).count().collect()}
    d = synth.plan(1, [2000], relevant=1, irrelevant=0)[0]
    for late, shares in ((False, d.base), (True, d.drifted)):
        for i, p in enumerate(shares, start=1):
            assert abs(share.get((late, f"value_{i}"), 0) / 2000 - p) < 0.05
    assert [a.name for a in synth.descriptors(2, 1)] == ["irrelevant_attribute_01", "relevant_attribute_01", "relevant_attribute_02"]
    with pytest.raises(ValueError):
        synth.drifted_pair(__import__("numpy").random.default_rng(1), 1)


def test_runs_by_window_against_whole_logs(spark):
    rng = random.Random(14)
    traces = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(48)]
    rows = [(t, i, a) for t, trace in enumerate(traces) for i, a in enumerate(trace)]
    events = spark.createDataFrame(rows, "trace_idx long, event_idx int, activity string")
    pairs = grid.fixed_grid(spark, 48, 12, slide=4)
    want = {}
    for p in pairs.collect():
        for side, (a, b) in enumerate(((p.a_start, p.a_end), (p.b_start, p.b_end))):
            for r in controlflow.runs(events.filter(F.col("trace_idx").between(a, b))).collect():
                want.setdefault((p.k, r.run), [0, 0])[side] += 1
    for pane in (1, 4):
        got = {(r.k, r.value): [r.o1, r.o2] for r in controlflow.runs_series_counts(events, pairs, pane).collect()}
        assert got == want


def test_attribute_series_and_own_comparison(spark):
    traces = drifting(spark, 300)
    pairs = grid.fixed_grid(spark, 300, 60, slide=20)
    from shiftscope.operators.histogram import paired_counts
    from shiftscope.sources.tables import long_values

    both = detect.attribute_series(long_values(traces, ["kind"]), long_values(traces, ["price"], kind="double"), pairs, 20)
    assert both.groupBy("detector").count().orderBy("detector").collect() == [("trace: kind", 10), ("trace: price", 10)]
    counts = paired_counts(long_values(traces, ["kind"]), pairs, 20)
    own = compare.user_comparer(counts, F.sum(F.abs(F.col("o1") - F.col("o2")))).collect()
    assert len(own) == 10 and all(r.value == 0 for r in own)
    known = detect.known_points(spark, [3, 5])
    assert [r.change_point for r in known.orderBy("change_point").collect()] == [3, 5]


def test_window_totals(spark):
    """Every histogram holds the traces of its windows, whatever the pane."""
    values = spark.range(500).select(F.lit("d").alias("detector"), F.col("id").alias("trace_idx"), F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("value"))
    from shiftscope.operators.histogram import paired_counts

    pairs = grid.fixed_grid(spark, 500, 40, slide=10)
    frames = [sorted(map(str, paired_counts(values, pairs, pane).collect())) for pane in (1, 5, 10)]
    assert frames[0] == frames[1] == frames[2]
    totals = paired_counts(values, pairs, 10).groupBy("k").agg(F.sum("o1").alias("a"), F.sum("o2").alias("b")).collect()
    assert len(totals) == pairs.count() and all((r.a, r.b) == (40, 40) for r in totals)
