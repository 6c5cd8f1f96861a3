"""Series from pane sums, running sums and blocks of positions against the same windows taken one by one; experiments by log."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import compare, controlflow, detect, experiments, grid, histogram
from shiftscope.session import release, written

VALUES = "detector string, trace_idx long, value string"


def test_relations_of_windows_are_sums_of_panes(spark):
    rng = random.Random(3)
    traces = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    events = spark.createDataFrame([(t, i, a) for t, trace in enumerate(traces) for i, a in enumerate(trace)], "trace_idx long, event_idx int, activity string")
    pairs = grid.fixed_grid(spark, 60, 20, slide=10)
    for pane in (1, 5, 10):
        entropy, _ = controlflow.feature_samples(events, pairs, "Relational Entropy", pane=pane)
        counts, columns = controlflow.feature_samples(events, pairs, "Relation Type Counts", pane=pane)
        got = {}
        for r in entropy.collect():
            got.setdefault((r.k, r.side), []).append(round(r.entropy, 9))
        kinds = {}
        for r in counts.collect():
            kinds.setdefault((r.k, r.side), []).append(str([r[c] for c in columns]))
        for p in pairs.collect():
            for side, (a, b) in ((1, (p.a_start, p.a_end)), (2, (p.b_start, p.b_end))):
                inside = events.filter(F.col("trace_idx").between(a, b))
                assert sorted(got[p.k, side]) == sorted(round(r.entropy, 9) for r in controlflow.relational_entropy(inside).collect())
                whole = controlflow.bidirectional_counts(inside).collect()
                assert sorted(kinds[p.k, side]) == sorted(str([float("nan") if r[c] is None else float(r[c]) for c in columns]) for r in whole)


@pytest.fixture(scope="module")
def some_values(spark):
    rng = random.Random(8)
    rows = [(d, t, rng.choice(["x", "y", "z", None]) if d == "few" else f"v{rng.randrange(150)}") for d in ("few", "many") for t in range(700)]
    # a trace may have several values, and none
    rows += [("few", t, "x") for t in range(0, 700, 9)]
    return spark.createDataFrame([r for r in rows if r[1] % 31], VALUES)


def counted_one_by_one(rows, pairs):
    want = {}
    for p in pairs:
        for d, t, v in rows:
            if p.a_start <= t <= p.a_end:
                want.setdefault((d, p.k, v), [0, 0])[0] += 1
            if p.b_start <= t <= p.b_end:
                want.setdefault((d, p.k, v), [0, 0])[1] += 1
    return want


@pytest.mark.parametrize("offset", [40, 25, 60])
def test_running_sums(spark, some_values, monkeypatch, offset):
    monkeypatch.setattr(histogram, "SUM_BLOCK", 128)
    rows = [tuple(r) for r in some_values.collect()]
    points = spark.createDataFrame([(7,), (200,), (260,), (643,)], "change_point long")
    pairs = grid.region_grid(points, 700, 40, 70, offset, slide=7)
    want = counted_one_by_one(rows, pairs.collect())
    got = {(r.detector, r.k, r.value): [r.o1, r.o2] for r in histogram.paired_counts(some_values, pairs).collect()}
    assert got == want
    few = some_values.filter("detector = 'few'")
    looked = histogram._looked_up(few, pairs)
    assert looked is not None and {(r.detector, r.k, r.value): [r.o1, r.o2] for r in looked.collect()} == {k: v for k, v in want.items() if k[0] == "few"}
    around = grid.around(spark, 20, 40)
    got = {(r.detector, r.k, r.value): [r.o1, r.o2] for r in histogram.paired_counts(some_values, around).collect()}
    assert got == counted_one_by_one(rows, around.collect())


@pytest.mark.parametrize("block", [1, 1 << 13])
def test_ks_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(compare, "KS_BLOCK", block)
    rng = random.Random(block)
    rows = [(d, t, rng.choice([None, 0.0, -0.0, 1.5, float("inf"), float("nan"), rng.random(), round(rng.random(), 1)])) for d in ("p", "q") for t in range(500) for _ in range(rng.randrange(3))]
    rows = [r for r in rows if not (r[0] == "q" and 100 < r[1] < 240)]
    values = spark.createDataFrame(rows, "detector string, trace_idx long, value double")
    points = spark.createDataFrame([(50,), (300,)], "change_point long")
    for pairs in (grid.fixed_grid(spark, 500, 30, slide=10), grid.region_grid(points, 500, 25, 60, 40, slide=7)):
        want = {(r.detector, r.k, r.x_end): (r.statistic, r.value) for r in compare.ks_test(histogram.paired_rows(values, pairs)).collect()}
        got = {(r.detector, r.k, r.x_end): (r.statistic, r.value) for r in compare.ks_series(values, pairs).collect()}
        assert got == want and any(v[0] is None for v in want.values())
    none = values.limit(0)
    assert compare.ks_series(none, pairs).collect() == [] and compare.ks_series(values, pairs.limit(0)).collect() == []


def test_experiments_by_log_are_those_of_each_log(spark):
    sizes, rows, base = {"a": 700, "b": 450, "c": 130}, [], 0
    rng = random.Random(2)
    own = {}
    for log, n in sizes.items():
        mine = [(f"trace: {d}", t, "late" if t >= n * cut // 10 and rng.random() < 0.7 else rng.choice(["u", "v", None])) for d, cut in (("one", 5), ("two", 3), ("none", 11)) for t in range(n)]
        own[log] = mine
        rows += [(d, base + t, v) for d, t, v in mine]
        base += n
    placed = [(log, sum(list(sizes.values())[:i]) + t) for i, (log, n) in enumerate(sizes.items()) for t in range(n)]
    spans = experiments.log_spans(spark.createDataFrame(placed, "log_id string, trace_idx long"))
    true = experiments.log_tenths(spans).filter("i IN (3, 5)").select("log_id", "change_point", F.when(F.col("i") == 5, "trace: one").otherwise("trace: two").alias("detector"))
    configs = [{"window_generator_type": "fixed", "window_size": w, "threshold": 0.05, "max_distance": d, "slide_by": s, "proportional_phi": p, "proportional_rho": 0.1} for w, d, s in ((20, 40, 2), (30, 25, 5)) for p in (0.1, 0.3)]
    got = {tuple(r) for r in experiments.experiments_by_log(spark.createDataFrame(rows, VALUES), spans, true, configs, "x").withColumn("all_lags", F.col("all_lags").cast("string")).collect()}
    want = set()
    for log, n in sizes.items():
        values = spark.createDataFrame(own[log], VALUES)
        mine = spark.createDataFrame([(n * 5 // 10, "trace: one"), (n * 3 // 10, "trace: two")], "change_point long, detector string")
        out = experiments.run_experiments(values, n, detect.tenths(spark, n), mine, configs, "x").withColumn("all_lags", F.col("all_lags").cast("string"))
        want |= {(log, *r) for r in out.collect()}
    assert got == want and len(got) == 12
    assert any(r[1] > 0 for r in got)
    with pytest.raises(ValueError):
        experiments.log_series(spark.createDataFrame(rows, VALUES), spans, true, [{**configs[0], "window_generator_type": "adaptive"}])


def test_release_waits_for_running_jobs(spark):
    from shiftscope.session import mark

    start = mark(spark)
    table = written(spark.range(64).repartition(64), "slow")
    failed = []

    def read():
        try:
            slow = table.rdd.map(lambda r: __import__("time").sleep(0.3) or r[0])
            assert slow.count() == 64
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        pass
    release(spark, start)
    reader.join()
    assert not failed


@pytest.mark.parametrize("criterion", ["all_events", "all_traces", "all_complete_traces"])
def test_time_windows_one_by_one(spark, criterion):
    from datetime import datetime, timedelta, timezone

    from shiftscope.operators import timewindows

    rng = random.Random(6)
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for t in range(80):
        begin = rng.randrange(0, 4000)
        for i in range(rng.randrange(1, 4)):
            rows.append((t, i, rng.choice("ab"), zero + timedelta(minutes=begin + 170 * i)))
    events = spark.createDataFrame(rows, "trace_idx long, event_idx int, activity string, ts timestamp")
    windows = timewindows.TimeWindows(timedelta(hours=10), timedelta(hours=2), timedelta(hours=12), criterion)
    axis = timewindows.TimeAxis.of(events, windows)
    pairs = axis.grid(spark, windows).collect()
    assert windows.tick == 2 * 3_600_000_000 and len(pairs) > 10
    if criterion == "all_events":
        values = events.select(F.lit("d").alias("detector"), F.col("activity").alias("value"), "ts")
    else:
        first = events.filter("event_idx = 0").select("trace_idx", F.lit("d").alias("detector"), F.col("activity").alias("value"))
        values = first.join(timewindows.trace_spans(events), "trace_idx")
    got = {(r.k, r.value): (r.o1, r.o2) for r in timewindows.paired_by_time(values, axis.grid(spark, windows), axis, criterion).collect()}
    micros = lambda ts: (ts - zero) // timedelta(microseconds=1)
    low = min(micros(r[3]) for r in rows)
    traces = {}
    for t, i, a, ts in rows:
        traces.setdefault(t, []).append((i, a, micros(ts)))
    want = {}
    for p in pairs:
        for side, start in enumerate((p.a_start, p.b_start)):
            s = low + start * windows.tick
            e = s + 10 * 3_600_000_000
            for own in traces.values():
                own = sorted(own)
                lo, hi = own[0][2], own[-1][2]
                if criterion == "all_events":
                    inside = [a for _, a, u in own if s <= u < e]
                else:
                    fits = lo < e and hi >= s if criterion == "all_traces" else lo >= s and hi < e
                    inside = [own[0][1]] * fits
                for a in inside:
                    want.setdefault((p.k, a), [0, 0])[side] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    series = timewindows.time_series(values, events, windows, lambda c: compare.g_test(c, 0)).collect()
    assert {r.x_end for r in series} <= {micros_end for micros_end in (int(zero.timestamp() * 1e6) + low + (p.b_end + 1) * windows.tick for p in pairs)}
    with pytest.raises(ValueError):
        timewindows.paired_by_time(values, axis.grid(spark, windows), axis, "some")


def test_unequal_sides_against_all_paths():
    from fractions import Fraction
    from math import comb

    rng = random.Random(1)
    for _ in range(150):
        n1, n2 = rng.randrange(1, 22), rng.randrange(1, 22)
        h = rng.randrange(n1 * n2 + 1)
        paths = {}
        for i in range(n1 + 1):
            for j in range(n2 + 1):
                inside = abs(i * n2 - j * n1) < h
                paths[i, j] = (1 if i == j == 0 else paths.get((i - 1, j), 0) + paths.get((i, j - 1), 0)) if inside else 0
        want = 1.0 if h == 0 else float(1 - Fraction(paths[n1, n2], comb(n1 + n2, n1)))
        assert compare.ks_p_unequal(h / (n1 * n2), n1, n2) == pytest.approx(want, abs=1e-10)


def test_drift_plans_as_rows(spark):
    from shiftscope.operators import synth

    drifts = synth.plan(5, [100, 200], relevant=3, irrelevant=2, k=4, kind="recurring", jitter=5.0)
    traces = spark.range(300).withColumnRenamed("id", "trace_idx")
    want = {r.trace_idx: {d.name: r[d.name] for d in drifts} for r in synth.with_drifts(traces, drifts, 31).collect()}
    rows = spark.createDataFrame([(31, synth._as_data(drifts))], f"seed int, drifts {synth._DRIFTS}")
    made = traces.crossJoin(rows).select("trace_idx", synth.drifted_values(F.col("seed"), F.col("drifts"), F.col("trace_idx")).alias("v"))
    assert {r.trace_idx: r.v for r in made.collect()} == want


def test_own_comparison_in_the_explainer(spark):
    from shiftscope.operators import explainer
    from shiftscope.schema import Attribute

    traces = spark.range(400).select(F.col("id").alias("trace_idx"), F.when((F.col("id") >= 200) & (F.col("id") % 5 < 3), "new").otherwise("old").alias("kind"))
    log = explainer.EventLog(traces, 400)
    windows, streaks = explainer.Windows(60, 20), explainer.Streaks(0.05, 1)
    series = {}
    for name, test in (("g", None), ("chi", compare.chi_squared), ("distance", compare.hellinger), ("own", lambda c: compare.user_comparer(c, -F.max(F.abs(F.col("o1") - F.col("o2")))))):
        found = explainer.attribute_detectors([Attribute("kind", "trace", "categorical")], windows, streaks, 0, test).changes(log)
        series[name] = {r.x_end: r.value for r in found.series.collect()}
    assert len({str(sorted(s.items())) for s in series.values()}) == 4 and all(len(s) == 15 for s in series.values())
    assert min(series["own"].values()) == -36


def test_time_detector(spark):
    from datetime import datetime, timedelta, timezone

    from shiftscope.operators import explainer, timewindows
    from shiftscope.schema import Attribute

    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(t, i, "late" if t >= 500 and t % 3 else "early", float(t % 7 + 40 * (t >= 700)), zero + timedelta(minutes=20 * t + i)) for t in range(1000) for i in range(2)]
    events = spark.createDataFrame(rows, "trace_idx long, event_idx int, activity string, cost double, ts timestamp")
    traces = events.filter("event_idx = 0").select("trace_idx", F.col("activity").alias("kind"))
    log = explainer.EventLog(traces, 1000, events)
    micros = lambda t: int(zero.timestamp() * 1e6) + 20 * 60_000_000 * t
    attributes = [Attribute("kind", "trace", "categorical"), Attribute("activity", "event", "categorical"), Attribute("cost", "event", "continuous")]
    windows = timewindows.TimeWindows(timedelta(hours=20), timedelta(hours=2), criterion="all_complete_traces")
    detector = explainer.TimeDetector(attributes, windows, explainer.Streaks(0.01, 2, 1))
    out = explainer.Explainer(explainer.KnownPoints([micros(500), micros(700)]), [detector]).explain(log, timedelta(hours=24))
    found = {(r.detector, r.primary_cp) for r in out.table.collect()}
    assert found == {("trace: kind", micros(500)), ("event: activity", micros(500)), ("event: cost", micros(700))}
    assert all(abs(r.lag) <= 24 * 3_600_000_000 for r in out.table.collect())
    with pytest.raises(NotImplementedError):
        detector.changes(log, unit="trace")
