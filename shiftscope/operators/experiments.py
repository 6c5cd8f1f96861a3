"""Parameter grids, experiments over logs, and their analysis."""

import math
import time
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftscope.operators.adaptive import adaptive_counts
from shiftscope.operators.compare import g_test
from shiftscope.operators.detect import explanations, phi_rho, streaks
from shiftscope.operators.grid import region_grid
from shiftscope.operators.histogram import paired_counts
from shiftscope.session import written

PARAMETERS = ("window_generator_type", "window_size", "threshold", "max_distance", "slide_by", "proportional_phi", "proportional_rho")
#: Numbers of pairs of a window plan stay below this, so that plans can share one histogram.
_PLAN = 1 << 40


def config_grid(spark: SparkSession, *lists: Sequence) -> DataFrame:
    """All combinations of the seven lists, one row each; the lists are the caller's own."""
    kinds = ("string", "int", "double", "int", "int", "double", "double")
    grid = spark.range(1, numPartitions=1)
    for name, kind, values in zip(PARAMETERS, kinds, lists, strict=True):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(x).cast(kind) for x in values]).cast(f"array<{kind}>")))
    return grid.drop("id")


def config_series(values: DataFrame, n_traces: int, primary: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """(config, detector, pos, x_end, value): the change series of all configurations, config being the place in the list.

    Configurations that differ in the streak filter only share their windows, and all fixed windows share one histogram.
    """
    spark = values.sparkSession
    plan = lambda c: (c["window_generator_type"], c["window_size"], c["slide_by"], c["max_distance"])
    plans = list(dict.fromkeys(map(plan, configs)))
    counted, grids = [], []
    for i, (kind, size, slide, distance) in enumerate(plans):
        if kind == "adaptive":
            own = adaptive_counts(values, size, slide, change_points=primary, max_distance=distance)
            counted.append(own.withColumn("k", F.col("k") + i * _PLAN).drop("region"))
        else:
            grids.append(region_grid(primary, n_traces, size, distance, slide=slide).withColumn("k", F.col("k") + i * _PLAN))
    if grids:
        counted.append(paired_counts(values, reduce(DataFrame.unionByName, grids)))
    series = g_test(reduce(DataFrame.unionByName, counted)).select("detector", (F.col("k") / _PLAN).cast("int").alias("plan"), (F.col("k") % _PLAN).alias("pos"), "x_end", "value")
    # one row a configuration
    which = spark.createDataFrame([(j, plans.index(plan(c))) for j, c in enumerate(configs)], "config int, plan int")
    return series.join(F.broadcast(which), "plan").select("config", "detector", "pos", "x_end", "value")


def explain_configs(values: DataFrame, n_traces: int, primary: DataFrame, configs: Sequence[dict]) -> list[DataFrame]:
    """The explanations that each configuration finds for primary change points, over all attributes in values."""
    spark = values.sparkSession
    rates = [phi_rho(c["window_size"], c["slide_by"], c["proportional_phi"], c["proportional_rho"]) for c in configs]
    filters = spark.createDataFrame([(j, c["threshold"], max(1, phi), rho) for j, (c, (phi, rho)) in enumerate(zip(configs, rates, strict=True))], "config int, threshold double, phi int, rho int")
    series = config_series(values, n_traces, primary, configs).join(F.broadcast(filters), "config")
    points = streaks(series, F.col("threshold"), F.col("phi"), F.col("rho"), ("config", "detector"))
    return [explanations(primary, points.filter(F.col("config") == j), c["max_distance"]) for j, c in enumerate(configs)]


def explain_config(values: DataFrame, n_traces: int, primary: DataFrame, config: dict) -> DataFrame:
    return explain_configs(values, n_traces, primary, [config])[0]


def _named(spark: SparkSession, configs: Sequence[dict]) -> DataFrame:
    """A row for each configuration: its place in the list, its parameters, and the streak filter that they give."""
    rates = [phi_rho(c["window_size"], c["slide_by"], c["proportional_phi"], c["proportional_rho"]) for c in configs]
    rows = [(j, *[c[p] for p in PARAMETERS], max(1, phi), rho) for j, (c, (phi, rho)) in enumerate(zip(configs, rates, strict=True))]
    return spark.createDataFrame(rows, "config int, window_generator_type string, window_size int, threshold double, max_distance int, slide_by int, proportional_phi double, proportional_rho double, phi int, rho int")


def _binned(points: DataFrame, width: Column, place: str, look: bool) -> DataFrame:
    """points with __bin, as wide as the reach of their configuration: their own one, or the three that they look into."""
    own = F.floor(F.col(place) / F.greatest(width, F.lit(1)))
    return points.withColumn("__bin", F.explode(F.array(own - 1, own, own + 1)) if look else own)


def evaluated(series: DataFrame, primary: DataFrame, true: DataFrame, configs: Sequence[dict], experiment: str) -> DataFrame:
    """One result row for each log and configuration, from (log_id, config, detector, pos, x_end, value).

    primary is (log_id, change_point), true (log_id, change_point, detector). Explanations are those within the configuration's distance of
    a primary change point, hits those within its window of a true one; both meet on bins of that width.
    """
    named = F.broadcast(_named(series.sparkSession, configs))
    key = ["log_id", "config"]
    filtered = series.join(named.select("config", "threshold", "phi", "rho"), "config")
    # the few points that are found are read more than once
    points = written(streaks(filtered, F.col("threshold"), F.col("phi"), F.col("rho"), (*key, "detector")), "experiment-points")
    points = points.join(named.select("config", "max_distance", "window_size"), "config")
    reach, window = F.col("max_distance"), F.col("window_size")
    p = primary.select("log_id", F.col("change_point").alias("p")).distinct().join(named.select("config", "max_distance"))
    looking = _binned(p, reach, "p", True).drop("max_distance")
    met = _binned(points, reach, "change_point", False).join(looking, [*key, "__bin"]).filter(F.abs(F.col("change_point") - F.col("p")) <= reach).drop("__bin")
    found = met.groupBy(*key).agg(F.count(F.lit(1)).alias("detections"))
    t = true.select("log_id", F.monotonically_increasing_id().alias("id"), F.col("change_point").alias("t"), "detector").join(named.select("config", "window_size"))
    wanted = _binned(t, window, "t", True).drop("window_size")
    near = _binned(met, window, "change_point", False).join(wanted, [*key, "detector", "__bin"]).filter(F.abs(F.col("change_point") - F.col("t")) <= window)
    first = near.groupBy(*key, "id", "t").agg((F.min("change_point") - F.col("t")).alias("lag"))
    hit = first.groupBy(*key).agg(F.count(F.lit(1)).alias("correct"), F.avg("lag").alias("mean_lag"), F.sort_array(F.collect_list(F.struct("t", "lag"))).alias("lags"))
    logs = true.groupBy("log_id").agg(F.count(F.lit(1)).alias("trues"))
    every = logs.join(named).join(found, key, "left").join(hit, key, "left").na.fill(0, ["detections", "correct"])
    rated = every.withColumns({"precision": F.try_divide("correct", "detections"), "recall": F.try_divide("correct", "trues")})
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 / (1 / F.col("precision") + 1 / F.col("recall")))
    lags = F.coalesce(F.col("lags.lag"), F.array().cast("array<bigint>"))
    return rated.select(
        "log_id",
        F.col("correct").alias("number_of_correct_detections"),
        F.col("trues").alias("number_of_true_changes"),
        F.col("detections").alias("number_of_detections"),
        "precision",
        "recall",
        f1.alias("f1_score"),
        "mean_lag",
        lags.alias("all_lags"),
        *[F.col(p).alias(f"config_{p}") for p in PARAMETERS],
        F.lit(experiment).alias("experiment"),
    )


def run_experiments(values: DataFrame, n_traces: int, primary: DataFrame, true: DataFrame, configs: list[dict], experiment: str) -> DataFrame:
    """One result row for each configuration on one log: its parameters, the evaluation, and the experiment's name."""
    log = F.lit("").alias("log_id")
    series = config_series(values, n_traces, primary, configs).select(log, "*")
    return evaluated(series, primary.select(log, "change_point"), true.select(log, "change_point", "detector"), configs, experiment).drop("log_id")


def log_spans(traces: DataFrame) -> DataFrame:
    """(log_id, log_no, base, n) of traces (log_id, trace_idx) whose positions run on from log to log, written: a row a log."""
    spans = traces.groupBy("log_id").agg(F.min("trace_idx").alias("base"), F.count_distinct("trace_idx").alias("n"))
    return written(spans.withColumn("log_no", F.row_number().over(Window.orderBy("base")) - 1), "log-spans")


def log_tenths(spans: DataFrame) -> DataFrame:
    """(log_id, i, change_point): the nine tenths of each log, counted within the log."""
    tenth = F.explode(F.sequence(F.lit(1), F.lit(9)))
    return spans.select("log_id", "n", tenth.alias("i")).select("log_id", "i", F.floor(F.col("i") * F.col("n") / 10).cast("long").alias("change_point"))


def log_region_grid(points: DataFrame, spans: DataFrame, plans: DataFrame) -> DataFrame:
    """Region grids of all logs and plans as one grid over the positions of all logs.

    points is (log_id, change_point), counted within the log, plans (plan, size, slide, distance). Regions and pairs are those
    of region_grid(), for each log and plan; k holds the log, the plan and the place among its pairs.
    """
    own = ["log_no", "plan"]
    # a row for each log and plan
    scopes = spans.join(F.broadcast(plans))
    n_plans = plans.count()
    regions = points.select("log_id", "change_point").join(scopes, "log_id")
    order = Window.partitionBy(*own).orderBy("change_point")
    placed = regions.withColumns(
        {
            "region": F.row_number().over(order) - 1,
            "s0": F.greatest(F.lit(0), F.col("change_point") - F.col("distance")),
            "e": F.least(F.col("n"), F.col("change_point") + F.col("distance")),
        }
    )
    size = F.col("size")
    start = F.greatest("s0", F.coalesce(F.lag("e").over(Window.partitionBy(*own).orderBy("region")), F.col("s0")))
    bounded = placed.withColumn("s", start).withColumns({"low": (F.greatest(F.lit(0), F.col("s") - 2 * size + 1) + 2 * size - 1).cast("long"), "high": F.least("e", F.col("n") - 1).cast("long")}).filter("low <= high")
    ends = bounded.select(*own, "base", "size", "region", F.explode(F.sequence("low", "high", F.col("slide").cast("long"))).alias("end"))
    kept = ends.groupBy(*own, "base", "size", "end").agg(F.min("region").alias("region"))
    pos = F.row_number().over(Window.partitionBy(*own).orderBy("region", "end")) - 1
    b = F.col("base") + F.col("end")
    k = (F.col("log_no") * n_plans + F.col("plan")).cast("long") * F.lit(_PLAN) + pos
    return kept.select("region", k.alias("k"), (b - 2 * size + 1).alias("a_start"), (b - size).alias("a_end"), (b - size + 1).alias("b_start"), b.alias("b_end"))


def log_series(values: DataFrame, spans: DataFrame, primary: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """(log_id, config, detector, pos, x_end, value) of fixed windows: all logs and configurations in one plan.

    values is (detector, trace_idx, value) with positions that run on from log to log (log_spans()); windows stay within a log.
    """
    spark = values.sparkSession
    plan = lambda c: (c["window_size"], c["slide_by"], c["max_distance"])
    if any(c["window_generator_type"] != "fixed" for c in configs):
        raise ValueError("adaptive windows walk a log at a time")
    known = list(dict.fromkeys(map(plan, configs)))
    plans = spark.createDataFrame([(i, *p) for i, p in enumerate(known)], "plan int, size int, slide int, distance int")
    grid = written(log_region_grid(primary, spans, plans), "log-grid")
    series = g_test(paired_counts(values, grid))
    which = spark.createDataFrame([(j, known.index(plan(c))) for j, c in enumerate(configs)], "config int, plan int")
    scope = F.shiftright("k", _PLAN.bit_length() - 1)
    placed = series.select("detector", F.floor(scope / len(known)).cast("int").alias("log_no"), (scope % len(known)).cast("int").alias("plan"), F.col("k").bitwiseAND(F.lit(_PLAN - 1)).alias("pos"), "x_end", "value")
    local = placed.join(spans.select("log_id", "log_no", "base"), "log_no").join(F.broadcast(which), "plan")
    return local.select("log_id", "config", "detector", "pos", (F.col("x_end") - F.col("base")).alias("x_end"), "value")


def experiments_by_log(values: DataFrame, spans: DataFrame, true: DataFrame, configs: list[dict], experiment: str) -> DataFrame:
    """One result row for each log and configuration, around the nine tenths of each log: jobs do not grow in number with the logs."""
    primary = log_tenths(spans)
    return evaluated(log_series(values, spans, primary, configs), primary, true, configs, experiment)


def experiments_over_logs(spark: SparkSession, logs: Mapping[str, tuple[DataFrame, int]], configs: list[dict], experiment: str, results_path: str, true_for, *, fresh: bool = False, limit: int | None = None) -> DataFrame:
    """Runs all configurations on each log, and appends the results with the log and its time.

    logs maps a name (a file's path) to its values and its number of traces; true_for(n_traces) gives the true
    (change_point, detector); the primary change points are the nine tenths. limit takes the first logs in the order of the names
    only, as in a trial; compute_time is the seconds of all divided by the logs and the configurations. Fixed windows of all
    logs are one plan; only adaptive ones walk log by log.
    """
    from shiftscope.operators.detect import tenths
    from shiftscope.sources.tables import append_results, read_results

    names = sorted(logs)[:limit]
    if not names:
        return read_results(spark, results_path)
    begin, base, placed, spans, true = time.perf_counter(), 0, [], [], []
    for i, name in enumerate(names):
        values, n = logs[name]
        placed.append(values.select("detector", (F.col("trace_idx") + base).alias("trace_idx"), "value"))
        spans.append((name, i, base, n))
        true.append(true_for(n).select(F.lit(name).alias("log_id"), "change_point", "detector"))
        base += n
    fixed, adaptive = ([c for c in configs if (c["window_generator_type"] == "fixed") == kind] for kind in (True, False))
    found = []
    if fixed:
        known = spark.createDataFrame(spans, "log_id string, log_no int, base long, n long")
        found.append(experiments_by_log(reduce(DataFrame.unionByName, placed), known, reduce(DataFrame.unionByName, true), fixed, experiment))
    for name in names if adaptive else ():
        values, n = logs[name]
        found.append(run_experiments(values, n, tenths(spark, n), true_for(n), adaptive, experiment).select(F.lit(name).alias("log_id"), "*"))
    rows = written(reduce(DataFrame.unionByName, found), "experiment-results")
    seconds = (time.perf_counter() - begin) / max(1, len(configs) * len(names))
    append_results(rows.withColumnRenamed("log_id", "config_event_log_file_path").withColumn("compute_time", F.lit(seconds)), results_path, fresh=fresh)
    return read_results(spark, results_path)


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, means and the ratios of the sums by keys."""
    counts = ("number_of_correct_detections", "number_of_true_changes", "number_of_detections")
    means = [c for c in ("precision", "recall", "f1_score", "mean_lag", "compute_time") if c in results.columns]
    grouped = results.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(f"avg_{c}") for c in means])
    p, r = F.try_divide(F.col(counts[0]), F.col(counts[2])), F.try_divide(F.col(counts[0]), F.col(counts[1]))
    return grouped.withColumns({"total_precision": p, "total_recall": r, "total_f1": F.when((p > 0) & (r > 0), 2 / (1 / p + 1 / r))})


def exponential_fit(x: Sequence[float], y: Sequence[float], start: tuple[float, float, float] = (1.0, 0.1, 1.0)) -> tuple[float, float, float]:
    """a, k, b of a * exp(-k x) + b by damped Gauss-Newton, for the few points of a summary."""
    x, y, w, damp = np.asarray(x, float), np.asarray(y, float), np.array(start, float), 1e-3
    error = lambda v: ((v[0] * np.exp(-v[1] * x) + v[2] - y) ** 2).sum()
    for _ in range(500):
        e = np.exp(-w[1] * x)
        slope = np.stack([e, -w[0] * x * e, np.ones_like(x)], axis=1)
        normal = slope.T @ slope
        step = np.linalg.solve(normal + damp * (np.diag(np.diag(normal)) + 1e-12 * np.eye(3)), slope.T @ (y - (w[0] * e + w[2])))
        if error(w + step) < error(w):
            w, damp = w + step, damp / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damp *= 4
            if not math.isfinite(damp) or damp > 1e12:
                break
    return tuple(map(float, w))
