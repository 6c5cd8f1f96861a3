"""Queries over the driver's tables as event logs, and the same in SQL."""

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftscope.operators import adaptive, compare, controlflow, detect, evaluate, experiments, explainer, explore, grid, histogram, synth, timewindows
from shiftscope.schema import Attribute, dense_index
from shiftscope.session import shared_dir, written
from shiftscope.sources import tables
from shiftscope.streaming import monitor

SIZE, SLIDE, DISTANCE = 200, 10, 300
PANE = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Orders as traces, with the columns that are wanted."""
    return tables.traces_of(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", *columns), ["o_orderdate", "o_orderkey"])


def _n(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "orders").count()


def _drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attributes of orders: the first drifts in the middle, the second at seven tenths, the third not."""
    n, key = _n(spark, sf_dir), F.col("o_orderkey")
    base = F.concat(F.lit("value_"), (key % 3 + 1).cast("string"))
    drift = lambda at, prime: F.when((F.col("trace_idx") >= at) & (key * prime % 10 < 6), "value_3").otherwise(base)
    some = F.when(key % 17 == 0, None).otherwise(base)
    return _orders(spark, sf_dir).select("trace_idx", drift(n * 5 // 10, 7919).alias("first"), drift(n * 7 // 10, 104729).alias("second"), some.alias("third"))


def _drifted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.long_values(_drifted(spark, sf_dir), ["first", "second", "third"])


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fixed_grid(spark, _n(spark, sf_dir), SIZE, slide=SLIDE)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n(spark, sf_dir)
    return grid.region_grid(detect.tenths(spark, n), n, SIZE, DISTANCE, slide=SLIDE)


def _r(column: str) -> F.Column:
    return F.round(F.col(column).cast("double"), 6).alias(column)


def _priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.paired_counts(tables.long_values(_orders(spark, sf_dir, "o_orderpriority"), ["o_orderpriority"]), _fixed(spark, sf_dir), PANE)


def change_series_gtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.g_test(_priority(spark, sf_dir)).select("x_end", _r("statistic"), "dof", _r("value"))


def change_series_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.chi_squared(_priority(spark, sf_dir)).select("x_end", _r("statistic"), "dof", _r("value"))


def change_series_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.hellinger(_priority(spark, sf_dir)).select("x_end", _r("value"))


def change_series_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = tables.long_values(_orders(spark, sf_dir, "o_totalprice"), ["o_totalprice"], kind="double")
    return compare.ks_series(values, _fixed(spark, sf_dir)).select("x_end", _r("statistic"), _r("value"))


def _drift_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = detect.change_series(_drifted_values(spark, sf_dir), _fixed(spark, sf_dir), compare.g_test, PANE)
    return detect.change_points(series, 0.05, 5, 2)


def phi_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift_points(spark, sf_dir)


def region_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = detect.change_series(_drifted_values(spark, sf_dir), _regions(spark, sf_dir), compare.g_test)
    return series.select("detector", "pos", "x_end", _r("value"))


def explanations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = detect.tenths(spark, _n(spark, sf_dir))
    return detect.explanations(primary, _drift_points(spark, sf_dir), DISTANCE)


def explanations_unrestricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.explanations(detect.tenths(spark, _n(spark, sf_dir)), _drift_points(spark, sf_dir))


def explanations_all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As explanations_unrestricted, with primary points that nothing explains, if there are any."""
    return detect.explanations(detect.tenths(spark, _n(spark, sf_dir)), _drift_points(spark, sf_dir), keep_unexplained=True)


def _true(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n(spark, sf_dir)
    return spark.createDataFrame([(n * 5 // 10, "trace: first"), (n * 7 // 10, "trace: second"), (n * 9 // 10, "trace: third")], "change_point long, detector string")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.flattened(explanations_table(spark, sf_dir))
    return evaluate.evaluate(_true(spark, sf_dir), found, SIZE)


def evaluate_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    lags = F.array_join(F.col("all_lags").cast("array<string>"), ",").alias("all_lags")
    return rows.select("number_of_correct_detections", "number_of_true_changes", "number_of_detections", _r("precision"), _r("recall"), _r("f1_score"), _r("mean_lag"), lags)


def evaluate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.evaluate_single(_true(spark, sf_dir), _drift_points(spark, sf_dir), SIZE)
    return rows.select("number_of_correct_detections", _r("precision"), _r("recall"), _r("f1_score"), _r("mean_lag"))


def aggregate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, found = _true(spark, sf_dir), _drift_points(spark, sf_dir)
    both = evaluate.evaluate(true, found, SIZE).unionByName(evaluate.evaluate(true, found, 30)).withColumn("experiment", F.lit("tolerance"))
    rows = evaluate.aggregated(both, ["experiment"])
    return rows.select("experiment", "number_of_correct_detections", "number_of_true_changes", "number_of_detections", "number_experiments", _r("precision"), _r("recall"), _r("f1_score"), _r("mean_lag"), F.array_join(F.col("all_lags").cast("array<string>"), ",").alias("all_lags"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return tables.events_of(events, ["user_id"], "event_type", "ts").select("trace_idx", "event_idx", "activity", "ts")


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_type")
    return tables.events_of(events, ["user_id", "day"], "event_type", "ts").select("trace_idx", "event_idx", "activity", "ts")


def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.activity_counts(_users(spark, sf_dir))


def causality_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.causality_counts(_users(spark, sf_dir))


def causality_preceded_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.causality_counts(_user_days(spark, sf_dir), "preceded_by")


def sna_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.relations(_user_days(spark, sf_dir))


def relation_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.relation_counts(_user_days(spark, sf_dir))


def bidirectional_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.bidirectional_counts(_user_days(spark, sf_dir))


def relational_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.relational_entropy(_user_days(spark, sf_dir)).select("activity", _r("entropy"))


def directly_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.directly_follows(_user_days(spark, sf_dir))


def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.concurrency(_user_days(spark, sf_dir))


def runs_by_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.runs(_user_days(spark, sf_dir)).groupBy("run").agg(F.count(F.lit(1)).alias("traces"))


def runs_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = controlflow.runs_series_counts(*_days_grid(spark, sf_dir), PANE, texts=False)
    return compare.g_test(counts, 0).select("x_end", _r("statistic"), "dof", _r("value"))


def activity_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.sequences(_user_days(spark, sf_dir)).select("trace_idx", F.array_join("activities", ">").alias("activities"))


def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = tables.long_values(_drifted(spark, sf_dir), ["third"])
    return explore.value_distribution(values, SIZE).select("key", "value", _r("share"))


def rolling_mean_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))
    rows = _orders(spark, sf_dir, "o_totalprice").select("trace_idx", price.alias("price"))
    return explore.rolling_mean(rows, "price", SIZE).select("trace_idx", F.round("rolling_mean", 2).alias("rolling_mean"))


def open_order_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "o_orderstatus").select("trace_idx", F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)).cast("int").alias("open"))
    return explore.rolling_mean(rows, "open", SIZE).select("trace_idx", _r("rolling_mean"))


def value_counts_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.before_after(_drifted(spark, sf_dir), "first", _n(spark, sf_dir) * 5 // 10, SIZE)
    return rows.select("value", "before", "after", _r("before_share"), _r("after_share"))


def describe_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n(spark, sf_dir)
    sided = _orders(spark, sf_dir, "o_totalprice").select(F.when(F.col("trace_idx") <= n // 2, "before").otherwise("after").alias("side"), F.col("o_totalprice").cast("double").alias("price"))
    rows = explore.describe(sided, "price", ["side"])
    return rows.select("side", "count", *[F.round(c, 3).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.correlations(_table(spark, sf_dir, "lineitem"), NUMERIC).select("c1", "c2", _r("corr"))


def correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    charge = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double")
    lines = _table(spark, sf_dir, "lineitem").select(*NUMERIC, charge.alias("charge"), (charge * (1 + F.col("l_tax"))).cast("double").alias("taxed"))
    return explore.correlated_columns(explore.correlations(lines, explore.numeric_columns(lines)), 0.5)


def top_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = compare.g_test(_priority(spark, sf_dir)).select("x_end", _r("value"))
    return explore.top(series, "value", 5, ["x_end"], descending=False)


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their lines as canonical traces and events of two logs; some attributes are missing from some rows."""
    orders = _orders(spark, sf_dir, "o_orderpriority", "o_orderstatus", "o_totalprice")
    log = F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd")
    known = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    status = F.when((F.col("o_orderkey") % 17 != 0) & (F.col("o_orderkey") % 2 == 0), F.col("o_orderstatus"))
    strings = F.create_map(F.lit("o_orderpriority"), F.col("o_orderpriority"), F.lit("o_orderstatus"), status)
    numbers = F.create_map(F.lit("o_totalprice"), F.col("o_totalprice").cast("double"))
    traces = orders.select(log.alias("log_id"), "trace_idx", F.col("o_orderkey").alias("case_id"), known(strings).alias("tattrs_str"), known(numbers).alias("tattrs_num"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    placed = lines.withColumn("event_idx", F.row_number().over(order) - 1).join(orders.select(log.alias("log_id"), "o_orderkey", "trace_idx"), F.col("l_orderkey") == F.col("o_orderkey"))
    flags = F.create_map(F.lit("l_returnflag"), F.col("l_returnflag"), F.lit("case:flag"), F.col("l_returnflag"))
    discounts = F.create_map(F.lit("l_discount"), F.when((F.col("l_discount") > 0.05) & (F.col("log_id") == "odd"), F.col("l_discount").cast("double")))
    events = placed.select("log_id", "trace_idx", "event_idx", F.col("l_returnflag").alias("activity"), known(flags).alias("eattrs_str"), known(discounts).alias("eattrs_num"))
    return traces, events


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.log_stats(*_canonical(spark, sf_dir))


def attribute_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.attribute_catalog(*_canonical(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


def attribute_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.attribute_catalog(*_canonical(spark, sf_dir), ["o_totalprice", "absent"], ["l_returnflag"]).withColumn("place", F.col("place").cast("long"))


def attribute_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces, events = _canonical(spark, sf_dir)
    return explore.attribute_presence(explore.trace_attributes(traces).unionAll(explore.event_attributes(events)), ["even", "odd"])


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.value_counts(_drifted(spark, sf_dir), "third")


def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.config_grid(spark, ["fixed", "adaptive"], [100, 150, 200], [0.05], [300], [10, 20], [0.1, 0.2, 0.3], [0.1])


def true_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tenths(spark, _n(spark, sf_dir))


#: The parameters of the grid that config_grid lists.
CONFIGS = [
    {"window_generator_type": kind, "window_size": size, "threshold": 0.05, "max_distance": DISTANCE, "slide_by": slide, "proportional_phi": phi, "proportional_rho": 0.1}
    for kind in ("fixed", "adaptive")
    for size in (100, 150, 200)
    for slide in (10, 20)
    for phi in (0.1, 0.2, 0.3)
]


def _summary(spark: SparkSession, sf_dir: str, configs: list[dict], keys: list[str]) -> DataFrame:
    n = _n(spark, sf_dir)
    results = experiments.run_experiments(_drifted_values(spark, sf_dir), n, detect.tenths(spark, n), _true(spark, sf_dir), configs, "initial")
    rows = experiments.summary(results, keys)
    return rows.select(*[_r(c) if rows.schema[c].dataType.simpleString() == "double" and c not in keys else F.col(c) for c in rows.columns])


def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, CONFIGS, ["config_window_generator_type", "config_window_size", "config_slide_by"])


def results_summary_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, [c for c in CONFIGS if c["window_generator_type"] == "fixed"], ["config_window_size", "config_slide_by", "config_proportional_phi"])


def results_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixed configurations on two logs, the orders of even and of odd keys, as one plan."""
    key = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(key % 2 == 0, "even").otherwise("odd").alias("log_id"))
    placed = dense_index(orders, [F.col("log_id"), F.col("o_orderdate"), key])
    spans = experiments.log_spans(placed)
    local = placed.join(F.broadcast(spans.select("log_id", "base", "n")), "log_id")
    at, n = F.col("trace_idx") - F.col("base"), F.col("n")
    base = F.concat(F.lit("value_"), (key % 3 + 1).cast("string"))
    drift = lambda tenth, prime: F.when((at >= F.floor(n * tenth / 10)) & (key * prime % 10 < 6), "value_3").otherwise(base)
    traces = local.select("trace_idx", drift(5, 7919).alias("first"), drift(7, 104729).alias("second"), F.when(key % 17 == 0, None).otherwise(base).alias("third"))
    names = {5: "trace: first", 7: "trace: second", 9: "trace: third"}
    true = experiments.log_tenths(spans).filter(F.col("i").isin(*names)).select("log_id", "change_point", F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("i")).alias("detector"))
    configs = [c for c in CONFIGS if c["window_generator_type"] == "fixed"]
    rows = experiments.experiments_by_log(tables.long_values(traces, ["first", "second", "third"]), spans, true, configs, "initial")
    lags = F.array_join(F.col("all_lags").cast("array<string>"), ",").alias("all_lags")
    counts = ["number_of_correct_detections", "number_of_true_changes", "number_of_detections"]
    return rows.select("log_id", "config_window_size", "config_slide_by", "config_proportional_phi", *counts, _r("precision"), _r("recall"), _r("f1_score"), _r("mean_lag"), lags)


def adaptive_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = adaptive.adaptive_counts(_drifted_values(spark, sf_dir), SIZE, SLIDE)
    return compare.g_test(counts).select("detector", "k", "x_end", _r("value"))


def adaptive_region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = detect.tenths(spark, _n(spark, sf_dir))
    counts = adaptive.adaptive_counts(_drifted_values(spark, sf_dir), SIZE, SLIDE, change_points=near, max_distance=DISTANCE)
    return compare.g_test(counts).select("detector", "k", "x_end", _r("value"))


def _mixed(spark: SparkSession, sf_dir: str) -> explainer.Explanations:
    """Two categorical attributes and a continuous one, which triples for some orders in the last third, around the nine tenths."""
    n, key = _n(spark, sf_dir), F.col("o_orderkey")
    base = F.concat(F.lit("value_"), (key % 3 + 1).cast("string"))
    first = F.when((F.col("trace_idx") >= n * 5 // 10) & (key * 7919 % 10 < 6), "value_3").otherwise(base)
    price = F.col("o_totalprice").cast("double") * F.when((F.col("trace_idx") >= n * 7 // 10) & (key % 2 == 0), 3).otherwise(1)
    traces = _orders(spark, sf_dir, "o_orderpriority", "o_totalprice").select("trace_idx", "o_orderpriority", first.alias("first"), price.alias("price"))
    attributes = [Attribute("o_orderpriority", "trace", "categorical"), Attribute("first", "trace", "categorical"), Attribute("price", "trace", "continuous")]
    secondary = explainer.attribute_detectors(attributes, explainer.Windows(SIZE, SLIDE), explainer.Streaks(0.05, 5, 2))
    primary = explainer.KnownPoints([i * n // 10 for i in range(1, 10)])
    return explainer.Explainer(primary, [secondary]).explain(explainer.EventLog(traces, n), DISTANCE)


def explainer_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).table


def explainer_mixed_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _mixed(spark, sf_dir), _n(spark, sf_dir)
    series = found.secondary.series.filter("detector = 'trace: price'")
    rows = detect.plot_data(series, found.secondary.points, found.primary.points, n // 2, n * 9 // 10)
    return rows.select("detector", "x_end", _r("value"), "is_cp", "is_primary")


def explainer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of the runs of days, from the middle on other ones, explained by two attributes around them, one of which changes there."""
    events = _user_days(spark, sf_dir)
    n = events.select("trace_idx").distinct().count()
    at = F.col("trace_idx")
    drifted = events.withColumn("activity", F.when((at >= n // 2) & (F.col("event_idx") == 0), "returned").otherwise(F.col("activity")))
    value = lambda factor, k: F.concat(F.lit("value_"), (at * factor % k + 1).cast("string"))
    first = F.when((at >= n * 5 // 10) & (at * 7919 % 10 < 6), "value_3").otherwise(value(31, 3))
    traces = events.select("trace_idx").distinct().select("trace_idx", first.alias("first"), value(17, 4).alias("other"))
    windows = explainer.Windows(SIZE, SLIDE)
    secondary = explainer.attribute_detectors([Attribute("first", "trace", "categorical"), Attribute("other", "trace", "categorical")], windows, explainer.Streaks(0.05, 5, 2))
    primary = explainer.ControlFlowDetector("Runs", windows, explainer.Streaks(0.01, 5, 2), 0)
    return explainer.Explainer(primary, [secondary]).explain(explainer.EventLog(traces, n, drifted), DISTANCE).table


def point_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _user_days(spark, sf_dir)
    n = events.select("trace_idx").distinct().count()
    return detect.timestamps(detect.tenths(spark, n), events).select("i", "change_point", "ts")


def parts_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of the first attribute that are found in four overlapping parts, as places in the whole log."""
    parts = detect.log_parts(_n(spark, sf_dir), 4, 2 * SIZE)
    placed = detect.in_parts(spark, _drifted(spark, sf_dir).select("trace_idx", "first"), parts)
    found = None
    for i, (start, end) in enumerate(parts):
        values = placed.filter(F.col("part") == i).select(F.lit("trace: first").alias("detector"), F.col("part_idx").alias("trace_idx"), F.col("first").alias("value"))
        points = detect.change_points(detect.change_series(values, grid.fixed_grid(spark, end - start + 1, SIZE, slide=SLIDE), compare.g_test, PANE), 0.05, 5, 2)
        own = points.select(F.lit(i).alias("part"), "change_point")
        found = own if found is None else found.unionAll(own)
    return detect.absolute_points(spark, found, parts)


def _days_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The days of users as events, and the grid over them."""
    events = _user_days(spark, sf_dir)
    return events, grid.fixed_grid(spark, events.select("trace_idx").distinct().count(), SIZE, slide=SLIDE)


def entropy_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = controlflow.feature_series(*_days_grid(spark, sf_dir), "Relational Entropy", pane=PANE)
    return found.select("x_end", _r("statistic"), _r("value"))


def relation_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlflow.feature_series(*_days_grid(spark, sf_dir), "Relation Type Counts", pane=PANE).select("x_end", _r("value"))


def relation_counts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means over activities of the six relation counts of each window, in both windows of each pair."""
    samples, columns = controlflow.feature_samples(*_days_grid(spark, sf_dir), "Relation Type Counts", pane=PANE)
    means = [F.round(F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))), 6).alias(c) for c in columns]
    return samples.groupBy("x_end", "side").agg(F.count(F.lit(1)).alias("activities"), *means)


def streaming_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The G-test series of order priorities, from pane counters that a stream of finished orders has kept."""
    placed = _orders(spark, sf_dir, "o_orderpriority")
    cases = placed.select(F.lit("trace: o_orderpriority").alias("detector"), "trace_idx", F.col("o_orderpriority").alias("value"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    source = written(cases, "stream-cases")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(source._shiftscope_path)
    panes = monitor.counted(stream, PANE, f"{shared_dir(spark)}/panes-{uuid.uuid4().hex}")
    return compare.g_test(monitor.paired_from_panes(panes, _fixed(spark, sf_dir), PANE)).select("x_end", _r("statistic"), "dof", _r("value"))


def hotelling_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "o_totalprice").select("trace_idx", F.log("o_totalprice").alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"))
    rows = rows.withColumn("detector", F.lit("price and key"))
    return compare.hotelling_panes(rows, _fixed(spark, sf_dir), ["x", "y"], PANE).select("x_end", _r("statistic"), _r("value"))


def synthetic_drift_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n(spark, sf_dir)
    cps = [int((i + 1) * n / 10) for i in range(9)]
    drifts = synth.plan(seed=7, change_points=cps, least=0.3)
    traces = synth.with_drifts(_orders(spark, sf_dir).select("trace_idx"), drifts)
    values = tables.long_values(traces, [d.name for d in drifts])
    found = experiments.explain_config(values, n, detect.tenths(spark, n), {**CONFIGS[0], "window_size": SIZE, "proportional_phi": 0.25})
    return evaluate.evaluate(synth.true_explanations(spark, drifts), detect.flattened(found), SIZE).drop("all_lags")


def time_window_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _users(spark, sf_dir)
    windows = timewindows.time_grid(events, "5 days")
    rows = None
    for criterion in ("all_events", "all_traces", "all_complete_traces"):
        own = timewindows.members(events, windows, criterion).groupBy("w").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("trace_idx").alias("traces")).withColumn("criterion", F.lit(criterion))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def _time_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of the days of users: what happens (detector, value, ts), what a day begins with (detector, value, lo, hi), and the events."""
    events = _user_days(spark, sf_dir)
    what = events.select(F.lit("event: activity").alias("detector"), F.col("activity").alias("value"), "ts")
    begins = events.filter("event_idx = 0").select("trace_idx", F.lit("trace: first").alias("detector"), F.col("activity").alias("value"))
    return what, begins.join(timewindows.trace_spans(events), "trace_idx"), events


def time_change_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-tests of five days against the next five, every day, by what happens in a window, and by the traces that touch it or lie in it."""
    what, begins, events = _time_values(spark, sf_dir)
    rows = None
    for criterion in ("all_events", "all_traces", "all_complete_traces"):
        windows = timewindows.TimeWindows(timedelta(days=5), timedelta(days=1), criterion=criterion)
        series = timewindows.time_series(what if criterion == "all_events" else begins, events, windows, lambda c: compare.g_test(c, 0))
        own = series.select(F.lit(criterion).alias("criterion"), "x_end", _r("statistic"), "dof", _r("value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def time_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a drift in the activities, from the middle of the time on, is found by time windows, within a week of the true time and of two others."""
    events = _user_days(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    drifted = events.withColumn("activity", F.when((at >= (lo + hi) // 2) & (at % 10 < 7), "other").otherwise(F.col("activity")))
    windows = timewindows.TimeWindows(timedelta(days=4), timedelta(hours=6))
    secondary = explainer.TimeDetector([Attribute("activity", "event", "categorical")], windows, explainer.Streaks(0.01, 2, 1))
    primary = explainer.KnownPoints([lo + (hi - lo) * i // 4 for i in (1, 2, 3)])
    log = explainer.EventLog(events.select("trace_idx").distinct(), 0, drifted)
    return explainer.Explainer(primary, [secondary]).explain(log, timedelta(days=7)).table


def around_change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = tables.long_values(_drifted(spark, sf_dir), ["first", "second", "third"])
    return histogram.paired_counts(values, grid.around(spark, _n(spark, sf_dir) // 2, SIZE)).select("detector", F.coalesce("value", F.lit("None")).alias("value"), "o1", "o2")


def example_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.example_traces(_orders(spark, sf_dir, "o_orderpriority", "o_totalprice"), 10, 3, ["o_orderpriority", "o_totalprice"])


def example_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.example_events(_user_days(spark, sf_dir), 10, 3, ["activity"]).withColumn("event_idx", F.col("event_idx").cast("long"))


def synthetic_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n(spark, sf_dir)
    return synth.truth(spark, synth.plan(seed=7, change_points=[int((i + 1) * n / 10) for i in range(9)], kind="recurring", jitter=20.0))


def ranked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cp = _n(spark, sf_dir) // 2
    near = _orders(spark, sf_dir, "o_totalprice").filter(F.col("trace_idx").between(cp - 199, cp + 200)).select(F.when(F.col("trace_idx") <= cp, "before").otherwise("after").alias("side"), F.col("o_totalprice").cast("double").alias("price"))
    return explore.ranked_values(near, "price", "side").select("side", "rank", F.round("value", 3).alias("value"))


# --- the same in SQL -------------------------------------------------------------------------------------------

_T = "t AS (SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS trace_idx, * FROM orders), n AS (SELECT count(*) AS n FROM orders)"
_GRID = f"grid AS (SELECT k, k * {SLIDE} AS a0, k * {SLIDE} + {SIZE} AS b0, k * {SLIDE} + {2 * SIZE - 1} AS x_end FROM (SELECT unnest(range(0, (n - {2 * SIZE}) // {SLIDE} + 1)) AS k FROM n))"
_DRIFT = """v AS (
  SELECT trace_idx, unnest(['trace: first', 'trace: second', 'trace: third']) AS detector, unnest([
    CASE WHEN trace_idx >= n * 5 // 10 AND o_orderkey * 7919 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + o_orderkey % 3) END,
    CASE WHEN trace_idx >= n * 7 // 10 AND o_orderkey * 104729 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + o_orderkey % 3) END,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'value_' || (1 + o_orderkey % 3) END]) AS value FROM t, n)"""
#: Pairs of time windows in microseconds: half-open, the second one after the first, those that end within the ticks of the log.
_TIMES = """tg AS (SELECT lo, (hi - lo) // {slide} + 1 AS ticks FROM lim), grid AS (SELECT k, lo + k * {slide} AS a0, lo + k * {slide} + {size} AS b0, lo + k * {slide} + 2 * {size} AS x_end
  FROM (SELECT lo, unnest(range(0, ticks - 2 * ({size} // {slide}) + 1)) AS k FROM tg))"""
_PRIORITY = "v AS (SELECT trace_idx, 'trace: o_orderpriority' AS detector, o_orderpriority AS value FROM t)"
_EXPECTED = """e AS (
  SELECT *, (o1 + o2) * t1 / (t1 + t2) AS e1, (o1 + o2) * t2 / (t1 + t2) AS e2 FROM (
    SELECT *, CAST(sum(o1) OVER p AS DOUBLE) AS t1, CAST(sum(o2) OVER p AS DOUBLE) AS t2, count(*) OVER p AS c FROM h WINDOW p AS (PARTITION BY detector, k)))"""
_COUNTS = f"""h AS (
  SELECT detector, k, x_end, value, count(*) FILTER (trace_idx < b0) AS o1, count(*) FILTER (trace_idx >= b0) AS o2
  FROM v JOIN grid ON trace_idx BETWEEN a0 AND x_end GROUP BY ALL
), {_EXPECTED}"""
_MOVED = """m AS (
  SELECT *, CASE WHEN c = 2 THEN o1 + sign(e1 - o1) * least(0.5, abs(e1 - o1)) ELSE o1 END AS m1,
    CASE WHEN c = 2 THEN o2 + sign(e2 - o2) * least(0.5, abs(e2 - o2)) ELSE o2 END AS m2 FROM e)"""
_G = "CASE WHEN m1 > 0 THEN 2 * m1 * ln(m1 / e1) ELSE 0 END + CASE WHEN m2 > 0 THEN 2 * m2 * ln(m2 / e2) ELSE 0 END"
_CHI = "(m1 - e1) * (m1 - e1) / e1 + (m2 - e2) * (m2 - e2) / e2"


def _scored(term: str, least: int = 5) -> str:
    return f"""s AS (
  SELECT detector, k, x_end, CASE WHEN min(least(e1, e2)) < {least} THEN NULL WHEN any_value(c) = 1 THEN 0 ELSE sum({term}) END AS statistic, CAST(any_value(c) - 1 AS BIGINT) AS dof
  FROM m GROUP BY detector, k, x_end
), series AS (
  SELECT detector, k, x_end, statistic, dof, CASE WHEN statistic IS NULL THEN NULL WHEN dof = 0 OR statistic <= 1e-12 THEN 1.0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 400),
    lambda i: exp((dof / 2.0 + i) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2.0 + i + 1))))) END AS value FROM s)"""


_POINTS = """below AS (SELECT detector, k, x_end, value, k - lag(k) OVER (PARTITION BY detector ORDER BY k) - 1 AS gap FROM series WHERE value <= 0.05),
islands AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY detector ORDER BY k) AS island FROM below),
points AS (SELECT detector, arg_min(x_end, k) AS change_point FROM islands GROUP BY detector, island HAVING count(*) >= 5)"""
_FOUND = f"{_T}, {_GRID}, {_DRIFT}, {_COUNTS}, {_MOVED}, {_scored(_G)}, {_POINTS}"
_TENTHS = "tenths AS (SELECT CAST(i AS INTEGER) AS i, CAST(i * n // 10 AS BIGINT) AS change_point FROM n, (SELECT unnest(range(1, 10)) AS i))"
_EXPLAINED = f"""explained AS (
  SELECT p.change_point AS primary_cp, CAST(row_number() OVER (PARTITION BY p.change_point ORDER BY abs(s.change_point - p.change_point), s.change_point, detector) AS INTEGER) AS rank,
    detector, s.change_point AS secondary_cp, s.change_point - p.change_point AS lag
  FROM tenths p JOIN points s ON abs(s.change_point - p.change_point) <= {DISTANCE})"""
_TRUE = "truth AS (SELECT 1 AS id, n * 5 // 10 AS t, 'trace: first' AS detector FROM n UNION ALL SELECT 2, n * 7 // 10, 'trace: second' FROM n UNION ALL SELECT 3, n * 9 // 10, 'trace: third' FROM n)"


def _evaluated(found: str, tolerance: int, by_detector: bool = True, name: str = "r") -> str:
    same = "AND f.detector = truth.detector" if by_detector else ""
    return f"""{name}_m AS (
  SELECT id, t, min(f.change_point) - t AS lag FROM truth LEFT JOIN {found} f ON abs(f.change_point - t) <= {tolerance} {same} GROUP BY id, t
), {name} AS (
  SELECT count(lag) AS correct, count(*) AS trues, (SELECT count(*) FROM {found}) AS detections, avg(lag) AS mean_lag,
    coalesce(string_agg(CAST(CAST(lag AS BIGINT) AS VARCHAR), ',' ORDER BY t) FILTER (lag IS NOT NULL), '') AS all_lags, coalesce(sum(lag), 0) AS lag_sum FROM {name}_m)"""


_RATIOS = """round(correct / nullif(detections, 0), 6) AS precision, round(correct / nullif(trues, 0), 6) AS recall,
  CASE WHEN correct > 0 THEN round(2.0 / (detections / correct + trues / correct), 6) END AS f1_score"""

_USERS = """c AS (SELECT user_id, CAST(row_number() OVER (ORDER BY min(ts), user_id) - 1 AS BIGINT) AS trace_idx FROM events GROUP BY user_id),
ev AS (SELECT trace_idx, row_number() OVER (PARTITION BY trace_idx ORDER BY ts) - 1 AS event_idx, event_type AS activity, ts FROM events JOIN c USING (user_id))"""
_DAYS = """c AS (SELECT user_id, day, CAST(row_number() OVER (ORDER BY min(ts), user_id, day) - 1 AS BIGINT) AS trace_idx FROM (SELECT user_id, CAST(ts AS DATE) AS day, ts FROM events) GROUP BY user_id, day),
ev AS (SELECT trace_idx, row_number() OVER (PARTITION BY trace_idx ORDER BY ts) - 1 AS event_idx, event_type AS activity, ts FROM events JOIN c ON events.user_id = c.user_id AND CAST(ts AS DATE) = c.day)"""
_CELLS = """long AS (SELECT *, max(event_idx) OVER (PARTITION BY trace_idx) AS last FROM ev),
early AS (SELECT DISTINCT activity AS a FROM long WHERE event_idx < last), every AS (SELECT DISTINCT activity AS b FROM long WHERE last > 0),
pairs AS (SELECT x.activity AS a, y.activity AS b, count(*) AS n FROM ev x JOIN ev y ON x.trace_idx = y.trace_idx AND x.event_idx < y.event_idx GROUP BY 1, 2),
cells AS (SELECT a, b, coalesce(n, 0) AS n FROM early CROSS JOIN every LEFT JOIN pairs USING (a, b)),
occurs AS (SELECT activity, count(*) AS o FROM ev GROUP BY activity),
followed AS (SELECT a AS a1, b AS a2, n, CASE WHEN n = o THEN 'a' WHEN n > 0 THEN 's' ELSE 'n' END AS relation FROM cells JOIN occurs ON b = activity),
preceded AS (SELECT b AS a1, a AS a2, n, CASE WHEN n = o THEN 'a' WHEN n > 0 THEN 's' ELSE 'n' END AS relation FROM cells JOIN occurs ON a = activity)"""


def _typed(frame: str) -> str:
    return f"SELECT a1 AS activity, count(*) FILTER (relation = 'a') AS always, count(*) FILTER (relation = 's') AS sometimes, count(*) FILTER (relation = 'n') AS never FROM {frame} GROUP BY a1"


_NEAR = "near AS (SELECT trace_idx, lead(activity) OVER (PARTITION BY trace_idx ORDER BY event_idx) AS y, activity AS x FROM ev)"
_DF = f"{_NEAR}, df AS (SELECT DISTINCT x AS a1, y AS a2 FROM near WHERE y IS NOT NULL), conc AS (SELECT d.a1, d.a2 FROM df d JOIN df r ON d.a1 = r.a2 AND d.a2 = r.a1)"
_CORR = ", ".join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :])
_CORR_ROWS = " UNION ALL ".join(f"SELECT '{x}' AS c1, '{y}' AS c2, {a}__{b} AS corr FROM k" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :] for x, y in ((a, b), (b, a)))
_LINES = [*NUMERIC, "charge", "taxed"]
_LINKED = ", ".join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(_LINES) for b in _LINES[i + 1 :])
_LINKED_ROWS = " UNION ALL ".join(f"SELECT '{x}' AS c1, '{y}' AS c2, {a}__{b} AS corr FROM k" for i, a in enumerate(_LINES) for b in _LINES[i + 1 :] for x, y in ((a, b), (b, a)))
_REGION = f"""cps AS (SELECT i AS o, greatest(0, change_point - {DISTANCE}) AS s0, least(n, change_point + {DISTANCE}) AS e, n FROM tenths, n),
cut AS (SELECT *, greatest(s0, coalesce(lag(e) OVER (ORDER BY o), s0)) AS s FROM cps),
spans AS (SELECT o, greatest(0, s - {2 * SIZE} + 1) + {2 * SIZE - 1} AS lo, least(e, n - 1) AS hi FROM cut),
ends AS (SELECT min(o) AS o, x_end FROM (SELECT o, unnest(range(lo, hi + 1, {SLIDE})) AS x_end FROM spans WHERE lo <= hi) GROUP BY x_end),
grid AS (SELECT row_number() OVER (ORDER BY o, x_end) - 1 AS k, x_end, x_end - {SIZE - 1} AS b0, x_end - {2 * SIZE - 1} AS a0 FROM ends)"""

_CUT = f"""cps AS (SELECT i AS o, greatest(0, change_point - {DISTANCE}) AS s0, least(n, change_point + {DISTANCE}) AS e, n FROM tenths, n),
cut AS (SELECT *, greatest(s0, coalesce(lag(e) OVER (ORDER BY o), s0)) AS s FROM cps)"""
_NAMES = """tl AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS log_id, * FROM t),
el AS (SELECT log_id, trace_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS event_idx, l_returnflag, l_discount FROM lineitem JOIN tl ON l_orderkey = o_orderkey),
names AS (SELECT log_id, 'trace' AS level, 'o_orderpriority' AS name, 'categorical' AS kind, trace_idx * 1000 AS place FROM tl UNION ALL SELECT log_id, 'trace', 'o_totalprice', 'continuous', trace_idx * 1000 FROM tl
  UNION ALL SELECT log_id, 'trace', 'o_orderstatus', 'categorical', trace_idx * 1000 FROM tl WHERE o_orderkey % 17 <> 0 AND log_id = 'even'
  UNION ALL SELECT log_id, 'event', 'l_returnflag', 'categorical', trace_idx * 1000 + event_idx FROM el UNION ALL SELECT log_id, 'event', 'l_discount', 'continuous', trace_idx * 1000 + event_idx FROM el WHERE l_discount > 0.05 AND log_id = 'odd')"""
_MIXED = f"""{_T}, {_TENTHS}, {_REGION},
v AS (SELECT trace_idx, unnest(['trace: o_orderpriority', 'trace: first']) AS detector, unnest([o_orderpriority, CASE WHEN trace_idx >= n * 5 // 10 AND o_orderkey * 7919 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + o_orderkey % 3) END]) AS value FROM t, n),
{_COUNTS}, {_MOVED}, {_scored(_G).replace('series AS (', 'categorical AS (')},
kv AS (SELECT trace_idx, CAST(o_totalprice AS DOUBLE) * CASE WHEN trace_idx >= n * 7 // 10 AND o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS value FROM t, n),
kh AS (SELECT k, x_end, value, count(*) FILTER (trace_idx < b0) AS o1, count(*) FILTER (trace_idx >= b0) AS o2 FROM kv JOIN grid ON trace_idx BETWEEN a0 AND x_end GROUP BY ALL),
kd AS (SELECT k, x_end, CAST(round(max(abs(c1 - c2))) AS BIGINT) AS j FROM (SELECT k, x_end, sum(o1) OVER w AS c1, sum(o2) OVER w AS c2 FROM kh WINDOW w AS (PARTITION BY k ORDER BY value)) GROUP BY k, x_end),
series AS (SELECT detector, k, x_end, value FROM categorical UNION ALL SELECT 'trace: price', k, x_end, CASE WHEN j = 0 THEN 1.0 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, {SIZE} // greatest(j, 1) + 1),
  lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(2 * lgamma({SIZE} + 1) - lgamma({SIZE} - i * j + 1) - lgamma({SIZE} + i * j + 1)))))) END FROM kd)"""

#: The change series of runs, with the concurrency of each window.
_RUNS = f"""n AS (SELECT count(*) AS n FROM c), {_GRID}, wins AS (SELECT a0 AS w FROM grid UNION SELECT b0 FROM grid),
ew AS (SELECT w, trace_idx, event_idx, activity FROM ev JOIN wins ON trace_idx BETWEEN w AND w + {SIZE - 1}),
near AS (SELECT w, trace_idx, activity AS x, lead(activity) OVER (PARTITION BY w, trace_idx ORDER BY event_idx) AS y FROM ew),
df AS (SELECT DISTINCT w, x AS a1, y AS a2 FROM near WHERE y IS NOT NULL), conc AS (SELECT d.w, d.a1, d.a2 FROM df d JOIN df r ON d.w = r.w AND d.a1 = r.a2 AND d.a2 = r.a1),
edges AS (SELECT DISTINCT w, trace_idx, x, y FROM near WHERE y IS NOT NULL AND x <> y),
more AS (SELECT w, trace_idx, x, y FROM edges UNION SELECT w, trace_idx, CASE WHEN a2 = y THEN y ELSE a2 END, CASE WHEN a2 = y THEN x ELSE y END FROM edges JOIN conc USING (w) WHERE a1 = x
  UNION SELECT w, trace_idx, x, a2 FROM edges JOIN conc USING (w) WHERE a1 = y AND a2 <> x),
texts AS (SELECT w, trace_idx, string_agg(x || '>' || y, ';' ORDER BY x, y) AS run FROM more GROUP BY ALL),
rw AS (SELECT w, coalesce(run, '') AS value, count(*) AS n FROM (SELECT DISTINCT w, trace_idx FROM ew) LEFT JOIN texts USING (w, trace_idx) GROUP BY ALL),
h AS (SELECT 'Runs' AS detector, k, x_end, value, sum(CASE WHEN w = a0 THEN rw.n ELSE 0 END) AS o1, sum(CASE WHEN w = b0 THEN rw.n ELSE 0 END) AS o2 FROM rw JOIN grid ON w = a0 OR w = b0 GROUP BY ALL),
{_EXPECTED}, {_MOVED}, {_scored(_G, 0)}"""
#: Relations of each window: cells of the traces, added up over all traces of a window.
_WINDOWS = f"""{_DAYS}, n AS (SELECT count(*) AS n FROM c), {_GRID}, wins AS (SELECT a0 AS w FROM grid UNION SELECT b0 FROM grid),
tl AS (SELECT *, max(event_idx) OVER (PARTITION BY trace_idx) AS last FROM ev),
ta AS (SELECT trace_idx, activity, count(*) AS occurs, count(*) FILTER (event_idx < last) AS early, count(*) FILTER (last > 0) AS every FROM tl GROUP BY ALL),
tc AS (SELECT x.trace_idx, x.activity AS a, y.activity AS b, count(*) AS n FROM ev x JOIN ev y ON x.trace_idx = y.trace_idx AND x.event_idx < y.event_idx GROUP BY ALL),
wa AS (SELECT w, activity, sum(occurs) AS o, sum(early) AS early, sum(every) AS every FROM ta JOIN wins ON trace_idx BETWEEN w AND w + {SIZE - 1} GROUP BY ALL),
wc AS (SELECT w, a, b, sum(n) AS n FROM tc JOIN wins ON trace_idx BETWEEN w AND w + {SIZE - 1} GROUP BY ALL),
wcells AS (SELECT e.w, e.activity AS a, v.activity AS b, coalesce(n, 0) AS n FROM wa e JOIN wa v ON e.w = v.w AND e.early > 0 AND v.every > 0 LEFT JOIN wc ON wc.w = e.w AND wc.a = e.activity AND wc.b = v.activity),
followed AS (SELECT x.w, a AS a1, b AS a2, CASE WHEN n = o THEN 'a' WHEN n > 0 THEN 's' ELSE 'n' END AS relation FROM wcells x JOIN wa ON wa.w = x.w AND activity = b),
preceded AS (SELECT x.w, b AS a1, a AS a2, CASE WHEN n = o THEN 'a' WHEN n > 0 THEN 's' ELSE 'n' END AS relation FROM wcells x JOIN wa ON wa.w = x.w AND activity = a)"""
_KINDS = "SELECT w, a1, count(*) FILTER (relation = 'a') AS {0}a, count(*) FILTER (relation = 's') AS {0}s, count(*) FILTER (relation = 'n') AS {0}n FROM {1} GROUP BY w, a1"
_BOTH = f"sided AS (SELECT * FROM ({_KINDS.format('f', 'followed')}) FULL JOIN ({_KINDS.format('p', 'preceded')}) USING (w, a1))"


def _f_tail(f: str, d1: str, d2: str) -> str:
    """The tail of the F distribution: the incomplete beta function as a series, from whichever end is nearer."""

    def beta(z: str, a: str, b: str) -> str:
        first = f"{a} * ln({z}) + {b} * ln(1 - ({z})) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
        return f"exp({first}) * list_sum(list_transform(range(0, 160), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({z}))))"

    z, a, b = f"({d2} / ({d2} + {d1} * {f}))", f"({d2} / 2)", f"({d1} / 2)"
    return f"CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 0 THEN 1.0 WHEN {z} <= 0.5 THEN {beta(z, a, b)} ELSE 1 - {beta(f'(1 - {z})', b, a)} END"


ORACLE_SQL = {
    "change_series_gtest": f"WITH {_T}, {_GRID}, {_PRIORITY}, {_COUNTS}, {_MOVED}, {_scored(_G)} SELECT x_end, round(statistic, 6) AS statistic, dof, round(value, 6) AS value FROM series",
    "change_series_chi2": f"WITH {_T}, {_GRID}, {_PRIORITY}, {_COUNTS}, {_MOVED}, {_scored(_CHI)} SELECT x_end, round(statistic, 6) AS statistic, dof, round(value, 6) AS value FROM series",
    "change_series_hellinger": f"WITH {_T}, {_GRID}, {_PRIORITY}, {_COUNTS} SELECT x_end, round(1 - sqrt(sum(pow(sqrt(o1 / t1) - sqrt(o2 / t2), 2))) / sqrt(2.0), 6) AS value FROM e GROUP BY x_end",
    "change_series_ks": f"""WITH {_T}, {_GRID}, v AS (SELECT trace_idx, CAST(o_totalprice AS DOUBLE) AS value FROM t),
h AS (SELECT x_end, value, count(*) FILTER (trace_idx < a0 + {SIZE}) AS o1, count(*) FILTER (trace_idx >= b0) AS o2 FROM v JOIN grid ON trace_idx BETWEEN a0 AND x_end GROUP BY ALL),
d AS (SELECT x_end, max(abs(c1 / {SIZE}.0 - c2 / {SIZE}.0)) AS statistic FROM (SELECT x_end, sum(o1) OVER w AS c1, sum(o2) OVER w AS c2 FROM h WINDOW w AS (PARTITION BY x_end ORDER BY value)) GROUP BY x_end),
f AS (SELECT *, CAST(round(statistic * {SIZE}) AS BIGINT) AS j FROM d)
SELECT x_end, round(statistic, 6) AS statistic, CASE WHEN j = 0 THEN 1.0 ELSE round(least(1, greatest(0, 2 * list_sum(list_transform(range(1, {SIZE} // greatest(j, 1) + 1),
  lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(2 * lgamma({SIZE} + 1) - lgamma({SIZE} - i * j + 1) - lgamma({SIZE} + i * j + 1)))))), 6) END AS value FROM f""",
    "phi_change_points": f"WITH {_FOUND} SELECT detector, change_point FROM points",
    "region_change_series": f"WITH {_T}, {_TENTHS}, {_REGION}, {_DRIFT}, {_COUNTS}, {_MOVED}, {_scored(_G)} SELECT detector, k AS pos, x_end, round(value, 6) AS value FROM series",
    "explanations_table": f"WITH {_FOUND}, {_TENTHS}, {_EXPLAINED} SELECT * FROM explained",
    "explanations_unrestricted": f"WITH {_FOUND}, {_TENTHS}, {_EXPLAINED.replace(f'ON abs(s.change_point - p.change_point) <= {DISTANCE}', 'ON true')} SELECT * FROM explained",
    "explanations_all_points": f"WITH {_FOUND}, {_TENTHS}, {_EXPLAINED.replace(f'ON abs(s.change_point - p.change_point) <= {DISTANCE}', 'ON true')} SELECT change_point AS primary_cp, rank, detector, secondary_cp, lag FROM tenths LEFT JOIN explained ON primary_cp = change_point",
    "evaluate_explanations": f"WITH {_FOUND}, {_TENTHS}, {_EXPLAINED}, {_TRUE}, flat AS (SELECT secondary_cp AS change_point, detector FROM explained), {_evaluated('flat', SIZE)} SELECT correct AS number_of_correct_detections, trues AS number_of_true_changes, detections AS number_of_detections, {_RATIOS}, round(mean_lag, 6) AS mean_lag, all_lags FROM r",
    "evaluate_single": f"WITH {_FOUND}, {_TRUE}, {_evaluated('points', SIZE, False)} SELECT correct AS number_of_correct_detections, {_RATIOS}, round(mean_lag, 6) AS mean_lag FROM r",
    "aggregate_results": f"""WITH {_FOUND}, {_TRUE}, {_evaluated('points', SIZE)}, {_evaluated('points', 30, True, 'q')},
u AS (SELECT CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(trues) AS BIGINT) AS trues, CAST(sum(detections) AS BIGINT) AS detections, count(*) AS number_experiments, sum(lag_sum) / nullif(sum(correct), 0) AS mean_lag FROM (SELECT * FROM r UNION ALL SELECT * FROM q)),
l AS (SELECT coalesce(string_agg(CAST(CAST(lag AS BIGINT) AS VARCHAR), ',' ORDER BY lag), '') AS all_lags FROM (SELECT lag FROM r_m UNION ALL SELECT lag FROM q_m) WHERE lag IS NOT NULL)
SELECT 'tolerance' AS experiment, correct AS number_of_correct_detections, trues AS number_of_true_changes, detections AS number_of_detections, number_experiments, {_RATIOS}, round(mean_lag, 6) AS mean_lag, all_lags FROM u, l""",
    "activity_counts": "SELECT event_type AS activity, count(*) AS n FROM events GROUP BY 1",
    "causality_followed_by": f"WITH {_USERS}, {_CELLS} SELECT a1, a2, n FROM followed",
    "causality_preceded_by": f"WITH {_DAYS}, {_CELLS} SELECT a1, a2, n FROM preceded",
    "sna_relations": f"WITH {_DAYS}, {_CELLS} SELECT a1, a2, n, relation FROM followed",
    "relation_type_counts": f"WITH {_DAYS}, {_CELLS} {_typed('followed')}",
    "bidirectional_relation_counts": f"""WITH {_DAYS}, {_CELLS}, f AS ({_typed('followed')}), p AS ({_typed('preceded')})
SELECT activity, f.always AS followed_by_always, f.sometimes AS followed_by_sometimes, f.never AS followed_by_never, p.always AS preceded_by_always, p.sometimes AS preceded_by_sometimes, p.never AS preceded_by_never FROM f FULL JOIN p USING (activity)""",
    "relational_entropy": f"""WITH {_DAYS}, {_CELLS}, f AS ({_typed('followed')}), g AS (SELECT *, count(*) OVER () AS c FROM f)
SELECT activity, round(list_sum(list_transform([always, sometimes, never], lambda x: CASE WHEN x > 0 THEN -(x / c) * log2(x / c) ELSE 0 END)), 6) AS entropy FROM g""",
    "directly_follows": f"WITH {_DAYS}, {_DF} SELECT a1, a2 FROM df",
    "concurrency": f"WITH {_DAYS}, {_DF} SELECT a1, a2 FROM conc",
    "runs_by_trace": f"""WITH {_DAYS}, {_DF}, edges AS (SELECT DISTINCT trace_idx, x, y FROM near WHERE y IS NOT NULL AND x <> y),
more AS (SELECT trace_idx, x, y FROM edges UNION SELECT trace_idx, CASE WHEN a2 = y THEN y ELSE a2 END, CASE WHEN a2 = y THEN x ELSE y END FROM edges JOIN conc ON a1 = x
  UNION SELECT trace_idx, x, a2 FROM edges JOIN conc ON a1 = y WHERE a2 <> x),
texts AS (SELECT trace_idx, string_agg(x || '>' || y, ';' ORDER BY x, y) AS run FROM more GROUP BY trace_idx)
SELECT coalesce(run, '') AS run, count(*) AS traces FROM (SELECT DISTINCT trace_idx FROM ev) LEFT JOIN texts USING (trace_idx) GROUP BY 1""",
    "activity_sequences": f"WITH {_DAYS} SELECT trace_idx, string_agg(activity, '>' ORDER BY event_idx) AS activities FROM ev GROUP BY trace_idx",
    "value_distribution": f"""WITH {_T}, {_DRIFT}, w AS (SELECT * FROM v WHERE detector = 'trace: third'), ks AS (SELECT unnest(range({SIZE}, n)) AS key FROM n),
c AS (SELECT key, value, count(*) AS c FROM ks JOIN w ON trace_idx >= key - {SIZE} AND trace_idx < key WHERE value IS NOT NULL GROUP BY ALL)
SELECT key, value, round(c / sum(c) OVER (PARTITION BY key), 6) AS share FROM c""",
    "rolling_mean_filled": f"""WITH {_T}, p AS (SELECT trace_idx, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price FROM t), f AS (SELECT trace_idx, coalesce(price, (SELECT avg(price) FROM p)) AS price FROM p)
SELECT trace_idx, CASE WHEN trace_idx >= {SIZE - 1} THEN round(avg(price) OVER (ORDER BY trace_idx ROWS {SIZE - 1} PRECEDING), 2) END AS rolling_mean FROM f""",
    "open_order_ratio": f"WITH {_T} SELECT trace_idx, CASE WHEN trace_idx >= {SIZE - 1} THEN round(avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (ORDER BY trace_idx ROWS {SIZE - 1} PRECEDING), 6) END AS rolling_mean FROM t",
    "value_counts_before_after": f"""WITH {_T}, {_DRIFT}, w AS (SELECT coalesce(value, 'None') AS value, trace_idx <= n * 5 // 10 AS early FROM v, n WHERE detector = 'trace: first' AND trace_idx BETWEEN n * 5 // 10 - {SIZE - 1} AND n * 5 // 10 + {SIZE}),
g AS (SELECT value, count(*) FILTER (early) AS before, count(*) FILTER (NOT early) AS after FROM w GROUP BY value) SELECT *, round(before / sum(before) OVER (), 6) AS before_share, round(after / sum(after) OVER (), 6) AS after_share FROM g""",
    "describe_before_after": f"""WITH {_T}, s AS (SELECT CASE WHEN trace_idx <= n // 2 THEN 'before' ELSE 'after' END AS side, CAST(o_totalprice AS DOUBLE) AS p FROM t, n)
SELECT side, count(p) AS count, round(avg(p), 3) AS mean, round(stddev_samp(p), 3) AS std, round(min(p), 3) AS min, round(quantile_cont(p, 0.25), 3) AS q25, round(quantile_cont(p, 0.5), 3) AS q50, round(quantile_cont(p, 0.75), 3) AS q75, round(max(p), 3) AS max FROM s GROUP BY side""",
    "correlation_pairs": f"WITH k AS (SELECT {_CORR} FROM lineitem) SELECT c1, c2, round(corr, 6) AS corr FROM ({_CORR_ROWS})",
    "correlated_columns": f"WITH lines AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMERIC)}, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS charge, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) * (1 + CAST(l_tax AS DOUBLE)) AS taxed FROM lineitem), k AS (SELECT {_LINKED} FROM lines) SELECT c1 AS column, string_agg(c2, ',' ORDER BY c2) AS correlated FROM ({_LINKED_ROWS}) WHERE abs(corr) > 0.5 GROUP BY c1",
    "top_pvalues": f"WITH {_T}, {_GRID}, {_PRIORITY}, {_COUNTS}, {_MOVED}, {_scored(_G)} SELECT x_end, round(value, 6) AS value FROM series ORDER BY round(value, 6) NULLS LAST, x_end LIMIT 5",
    "log_stats": f"""WITH {_T}, {_NAMES}, logs AS (SELECT unnest(['even', 'odd']) AS log_id)
SELECT log_id, (SELECT count(*) FROM tl WHERE tl.log_id = logs.log_id) AS traces, (SELECT count(*) FROM el WHERE el.log_id = logs.log_id) AS events,
  (SELECT count(DISTINCT name) FROM names WHERE names.log_id = logs.log_id AND level = 'trace') AS trace_attributes, (SELECT count(DISTINCT name) FROM names WHERE names.log_id = logs.log_id AND level = 'event') AS event_attributes FROM logs""",
    "attribute_catalog": f"WITH {_T}, {_NAMES} SELECT level, name, any_value(kind) AS kind, row_number() OVER (ORDER BY level DESC, min(place), name) - 1 AS place FROM names GROUP BY level, name",
    "attribute_whitelist": f"WITH {_T}, {_NAMES} SELECT level, name, any_value(kind) AS kind, row_number() OVER (ORDER BY level DESC, min(place), name) - 1 AS place FROM names WHERE name IN ('o_totalprice', 'l_returnflag') GROUP BY level, name",
    "attribute_presence": f"WITH {_T}, {_NAMES} SELECT name AS attribute, bool_or(log_id = 'even') AS even, bool_or(log_id = 'odd') AS odd FROM names GROUP BY name",
    "value_counts": f"WITH {_T}, {_DRIFT} SELECT value, count(*) AS n FROM v WHERE detector = 'trace: third' AND value IS NOT NULL GROUP BY value",
    "example_traces": f"WITH {_T} SELECT trace_idx, o_orderpriority, o_totalprice FROM t ORDER BY md5('3:' || trace_idx), trace_idx LIMIT 10",
    "example_events": f"""WITH {_DAYS}, drawn AS (SELECT trace_idx FROM c ORDER BY md5('3:' || trace_idx), trace_idx LIMIT 10)
SELECT trace_idx, event_idx, activity FROM ev JOIN drawn USING (trace_idx) QUALIFY row_number() OVER (PARTITION BY trace_idx ORDER BY md5('3:' || trace_idx || ':' || event_idx), event_idx) = 1""",
    "point_timestamps": f"""WITH {_DAYS}, n AS (SELECT count(*) AS n FROM c), {_TENTHS} SELECT i, change_point, ts FROM tenths LEFT JOIN ev ON trace_idx = change_point AND event_idx = 0""",
    "parts_of_log": f"""WITH {_T}, parts AS (SELECT i, greatest(0, i * n // 4 - CASE WHEN i > 0 THEN {2 * SIZE} ELSE 0 END) AS lo, (i + 1) * n // 4 - 1 AS hi FROM n, (SELECT unnest(range(0, 4)) AS i)),
grid AS (SELECT 'part ' || i AS part, i * 1000000 + j AS k, lo + j * {SLIDE} AS a0, lo + j * {SLIDE} + {SIZE} AS b0, lo + j * {SLIDE} + {2 * SIZE - 1} AS x_end FROM (SELECT *, unnest(range(0, (hi - lo + 1 - {2 * SIZE}) // {SLIDE} + 1)) AS j FROM parts)),
w AS (SELECT trace_idx, CASE WHEN trace_idx >= n * 5 // 10 AND o_orderkey * 7919 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + o_orderkey % 3) END AS value FROM t, n),
h AS (SELECT part AS detector, k, x_end, value, count(*) FILTER (trace_idx < b0) AS o1, count(*) FILTER (trace_idx >= b0) AS o2 FROM w JOIN grid ON trace_idx BETWEEN a0 AND x_end GROUP BY ALL),
{_EXPECTED}, {_MOVED}, {_scored(_G)}, {_POINTS} SELECT DISTINCT change_point FROM points""",
    "results_summary_fixed": f"""WITH {_T}, {_TENTHS}, {_TRUE}, {_CUT}, combos AS (SELECT * FROM (SELECT unnest([100, 150, 200]) AS ws), (SELECT unnest([10, 20]) AS sl)),
spans AS (SELECT ws, sl, o, greatest(0, s - 2 * ws + 1) + 2 * ws - 1 AS lo, least(e, n - 1) AS hi FROM cut, combos),
ends AS (SELECT ws, sl, min(o) AS o, x_end FROM (SELECT ws, sl, o, unnest(range(lo, hi + 1, sl)) AS x_end FROM spans WHERE lo <= hi) GROUP BY ws, sl, x_end),
grid AS (SELECT (CAST(ws AS BIGINT) * 100 + sl) * 1000000 + row_number() OVER (PARTITION BY ws, sl ORDER BY o, x_end) - 1 AS k, x_end, x_end - ws + 1 AS b0, x_end - 2 * ws + 1 AS a0 FROM ends),
{_DRIFT}, {_COUNTS}, {_MOVED}, {_scored(_G)}, configs AS (SELECT ws, sl, p, ceil(p * ws / sl) AS phi, ceil(0.1::DOUBLE * ws / sl) AS rho FROM combos, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS p)),
below AS (SELECT ws, sl, p, phi, rho, detector, k, x_end, k - lag(k) OVER (PARTITION BY ws, sl, p, detector ORDER BY k) - 1 AS gap FROM series JOIN configs ON k // 1000000 = ws * 100 + sl WHERE value <= 0.05),
islands AS (SELECT *, sum(CASE WHEN gap <= rho THEN 0 ELSE 1 END) OVER (PARTITION BY ws, sl, p, detector ORDER BY k) AS island FROM below),
points AS (SELECT ws, sl, p, detector, arg_min(x_end, k) AS change_point FROM islands GROUP BY ws, sl, p, phi, detector, island HAVING count(*) >= phi),
met AS (SELECT ws, sl, p, points.detector, points.change_point FROM points JOIN tenths ON abs(points.change_point - tenths.change_point) <= {DISTANCE}),
hit AS (SELECT ws, sl, p, id, min(change_point) - t AS lag FROM met JOIN truth ON met.detector = truth.detector AND abs(met.change_point - t) <= ws GROUP BY ws, sl, p, id, t),
r AS (SELECT ws, sl, p, (SELECT count(*) FROM hit WHERE (hit.ws, hit.sl, hit.p) = (c.ws, c.sl, c.p)) AS correct, 3 AS trues, (SELECT count(*) FROM met WHERE (met.ws, met.sl, met.p) = (c.ws, c.sl, c.p)) AS detections,
  (SELECT avg(lag) FROM hit WHERE (hit.ws, hit.sl, hit.p) = (c.ws, c.sl, c.p)) AS mean_lag FROM configs c),
x AS (SELECT ws, sl, p, CAST(correct AS BIGINT) AS number_of_correct_detections, CAST(trues AS BIGINT) AS number_of_true_changes, CAST(detections AS BIGINT) AS number_of_detections, {_RATIOS}, round(mean_lag, 6) AS mean_lag FROM r)
SELECT ws AS config_window_size, sl AS config_slide_by, p AS config_proportional_phi, number_of_correct_detections, number_of_true_changes, number_of_detections,
  precision AS avg_precision, recall AS avg_recall, f1_score AS avg_f1_score, mean_lag AS avg_mean_lag, precision AS total_precision, recall AS total_recall, f1_score AS total_f1 FROM x""",
    "results_by_log": f"""WITH t AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS trace_idx, o_orderkey, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS g, * FROM orders)),
logs AS (SELECT DISTINCT g, n FROM t), tenths AS (SELECT g, n, i, i * n // 10 AS change_point FROM logs, range(1, 10) r(i)),
truth AS (SELECT g, i AS id, change_point AS t, CASE i WHEN 5 THEN 'trace: first' WHEN 7 THEN 'trace: second' ELSE 'trace: third' END AS detector FROM tenths WHERE i IN (5, 7, 9)),
cps AS (SELECT g, n, i AS o, greatest(0, change_point - {DISTANCE}) AS s0, least(n, change_point + {DISTANCE}) AS e FROM tenths),
cut AS (SELECT *, greatest(s0, coalesce(lag(e) OVER (PARTITION BY g ORDER BY o), s0)) AS s FROM cps),
combos AS (SELECT * FROM (SELECT unnest([100, 150, 200]) AS ws), (SELECT unnest([10, 20]) AS sl)),
spans AS (SELECT g, ws, sl, o, greatest(0, s - 2 * ws + 1) + 2 * ws - 1 AS lo, least(e, n - 1) AS hi FROM cut, combos),
ends AS (SELECT g, ws, sl, min(o) AS o, x_end FROM (SELECT g, ws, sl, o, unnest(range(lo, hi + 1, sl)) AS x_end FROM spans WHERE lo <= hi) GROUP BY g, ws, sl, x_end),
grid AS (SELECT g, ((CASE g WHEN 'odd' THEN 1000000 ELSE 0 END + CAST(ws AS BIGINT) * 100 + sl) * 1000000) + row_number() OVER (PARTITION BY g, ws, sl ORDER BY o, x_end) - 1 AS k, x_end, x_end - ws + 1 AS b0, x_end - 2 * ws + 1 AS a0 FROM ends),
v AS (SELECT g, trace_idx, unnest(['trace: first', 'trace: second', 'trace: third']) AS detector, unnest([
  CASE WHEN trace_idx >= n * 5 // 10 AND o_orderkey * 7919 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + o_orderkey % 3) END,
  CASE WHEN trace_idx >= n * 7 // 10 AND o_orderkey * 104729 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + o_orderkey % 3) END,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'value_' || (1 + o_orderkey % 3) END]) AS value FROM t),
h AS (SELECT detector, k, x_end, value, count(*) FILTER (trace_idx < b0) AS o1, count(*) FILTER (trace_idx >= b0) AS o2 FROM v JOIN grid ON v.g = grid.g AND trace_idx BETWEEN a0 AND x_end GROUP BY ALL),
{_EXPECTED}, {_MOVED}, {_scored(_G)},
configs AS (SELECT g, ws, sl, p, ceil(p * ws / sl) AS phi, ceil(0.1::DOUBLE * ws / sl) AS rho FROM logs, combos, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS p)),
below AS (SELECT g, ws, sl, p, phi, rho, detector, k, x_end, k - lag(k) OVER (PARTITION BY g, ws, sl, p, detector ORDER BY k) - 1 AS gap FROM series
  JOIN configs ON k // 1000000 = CASE g WHEN 'odd' THEN 1000000 ELSE 0 END + ws * 100 + sl WHERE value <= 0.05),
islands AS (SELECT *, sum(CASE WHEN gap <= rho THEN 0 ELSE 1 END) OVER (PARTITION BY g, ws, sl, p, detector ORDER BY k) AS island FROM below),
points AS (SELECT g, ws, sl, p, detector, arg_min(x_end, k) AS change_point FROM islands GROUP BY g, ws, sl, p, phi, detector, island HAVING count(*) >= phi),
met AS (SELECT points.* FROM points JOIN tenths ON points.g = tenths.g AND abs(points.change_point - tenths.change_point) <= {DISTANCE}),
found AS (SELECT g, ws, sl, p, count(*) AS detections FROM met GROUP BY ALL),
hit AS (SELECT met.g, ws, sl, p, t, min(change_point) - t AS lag FROM met JOIN truth ON met.g = truth.g AND met.detector = truth.detector AND abs(change_point - t) <= ws GROUP BY met.g, ws, sl, p, t),
hits AS (SELECT g, ws, sl, p, count(*) AS correct, avg(lag) AS mean_lag, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY t) AS all_lags FROM hit GROUP BY ALL),
r AS (SELECT g, ws, sl, p, coalesce(correct, 0) AS correct, 3 AS trues, coalesce(detections, 0) AS detections, mean_lag, coalesce(all_lags, '') AS all_lags FROM configs LEFT JOIN found USING (g, ws, sl, p) LEFT JOIN hits USING (g, ws, sl, p))
SELECT g AS log_id, ws AS config_window_size, sl AS config_slide_by, p AS config_proportional_phi, CAST(correct AS BIGINT) AS number_of_correct_detections, CAST(trues AS BIGINT) AS number_of_true_changes,
  CAST(detections AS BIGINT) AS number_of_detections, {_RATIOS}, round(mean_lag, 6) AS mean_lag, all_lags FROM r""",
    "explainer_mixed": f"WITH {_MIXED}, {_POINTS}, {_EXPLAINED} SELECT * FROM explained",
    "explainer_mixed_plot": f"""WITH {_MIXED}, {_POINTS} SELECT detector, x_end, round(value, 6) AS value, x_end IN (SELECT change_point FROM points WHERE detector = 'trace: price') AS is_cp, x_end IN (SELECT change_point FROM tenths) AS is_primary
FROM series, n WHERE detector = 'trace: price' AND x_end BETWEEN n // 2 AND n * 9 // 10""",
    "streaming_change_series": f"WITH {_T}, {_GRID}, {_PRIORITY}, {_COUNTS}, {_MOVED}, {_scored(_G)} SELECT x_end, round(statistic, 6) AS statistic, dof, round(value, 6) AS value FROM series",
    "hotelling_series": f"""WITH {_T}, {_GRID}, v AS (SELECT trace_idx, ln(CAST(o_totalprice AS DOUBLE)) AS x, CAST(o_orderkey % 97 AS DOUBLE) AS y FROM t),
m AS (SELECT k, x_end, trace_idx < b0 AS one, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM v JOIN grid ON trace_idx BETWEEN a0 AND x_end GROUP BY ALL),
d AS (SELECT k, x_end, sum(CASE WHEN one THEN mx ELSE -mx END) AS dx, sum(CASE WHEN one THEN my ELSE -my END) AS dy, avg(sxx) AS sxx, avg(syy) AS syy, avg(sxy) AS sxy FROM m GROUP BY k, x_end),
f AS (SELECT x_end, {SIZE} / 2.0 * (dx * dx * syy - 2 * dx * dy * sxy + dy * dy * sxx) / (sxx * syy - sxy * sxy) * {2 * SIZE - 3} / (2.0 * {2 * SIZE - 2}) AS statistic FROM d)
SELECT x_end, round(statistic, 6) AS statistic, round(pow(1 + 2 * statistic / {2 * SIZE - 3}, -{2 * SIZE - 3} / 2.0), 6) AS value FROM f""",
    "runs_change_series": f"WITH {_DAYS}, {_RUNS} SELECT x_end, round(statistic, 6) AS statistic, dof, round(value, 6) AS value FROM series",
    "explainer_runs": f"""WITH c AS (SELECT user_id, day, CAST(row_number() OVER (ORDER BY min(ts), user_id, day) - 1 AS BIGINT) AS trace_idx FROM (SELECT user_id, CAST(ts AS DATE) AS day, ts FROM events) GROUP BY user_id, day),
n AS (SELECT count(*) AS n FROM c),
raw AS (SELECT trace_idx, row_number() OVER (PARTITION BY trace_idx ORDER BY ts) - 1 AS event_idx, event_type AS activity FROM events JOIN c ON events.user_id = c.user_id AND CAST(ts AS DATE) = c.day),
ev AS (SELECT trace_idx, event_idx, CASE WHEN trace_idx >= n // 2 AND event_idx = 0 THEN 'returned' ELSE activity END AS activity FROM raw, n),
tenths AS (SELECT CAST(row_number() OVER (ORDER BY change_point) AS INTEGER) AS i, change_point FROM (WITH {_RUNS.split(', ', 1)[1]}, {_POINTS.replace('0.05', '0.01')} SELECT change_point FROM points)),
{_REGION}, v AS (SELECT trace_idx, unnest(['trace: first', 'trace: other']) AS detector, unnest([
  CASE WHEN trace_idx >= n * 5 // 10 AND trace_idx * 7919 % 10 < 6 THEN 'value_3' ELSE 'value_' || (1 + trace_idx * 31 % 3) END, 'value_' || (1 + trace_idx * 17 % 4)]) AS value FROM c, n),
{_COUNTS}, {_MOVED}, {_scored(_G)}, {_POINTS}, {_EXPLAINED} SELECT * FROM explained""",
    "entropy_change_series": f"""WITH {_WINDOWS},
typed AS (SELECT w, a1, count(*) FILTER (relation = 'a') AS na, count(*) FILTER (relation = 's') AS ns, count(*) FILTER (relation = 'n') AS nn, count(*) OVER (PARTITION BY w) AS c FROM followed GROUP BY w, a1),
ent AS (SELECT w, list_sum(list_transform([na, ns, nn], lambda x: CASE WHEN x > 0 THEN -(x / c) * log2(x / c) ELSE 0 END)) AS h FROM typed),
stat AS (SELECT w, count(*) AS n, avg(h) AS m, var_samp(h) AS s FROM ent GROUP BY w),
two AS (SELECT x_end, p.n AS n1, q.n AS n2, p.m - q.m AS d, ((p.n - 1) * p.s + (q.n - 1) * q.s) / (p.n + q.n - 2) AS s FROM grid JOIN stat p ON p.w = a0 JOIN stat q ON q.w = b0),
f AS (SELECT x_end, CASE WHEN s = 0 THEN 0.0 ELSE n1 * n2 / (n1 + n2) * d * d / s END AS f, CAST(n1 + n2 - 2 AS DOUBLE) AS m FROM two)
SELECT x_end, round(f, 6) AS statistic, round({_f_tail('f', '1.0', 'm')}, 6) AS value FROM f""",
    "relation_change_series": f"""WITH {_WINDOWS}, {_BOTH},
stat AS (SELECT w, count(*) AS n, bool_or(fa IS NULL OR pa IS NULL) AS lacking FROM sided GROUP BY w)
SELECT x_end, CASE WHEN p.lacking OR q.lacking OR least(p.n, q.n) < 2 OR p.n + q.n - 7 <= 0 THEN NULL ELSE 1.0::DOUBLE END AS value FROM grid JOIN stat p ON p.w = a0 JOIN stat q ON q.w = b0""",
    "relation_counts_by_window": f"""WITH {_WINDOWS}, {_BOTH}, ends AS (SELECT x_end, 1 AS side, a0 AS w FROM grid UNION ALL SELECT x_end, 2, b0 FROM grid)
SELECT x_end, side, count(*) AS activities, {', '.join(f'round(avg({c}), 6) AS {name}' for c, name in (('fa', 'followed_by_always'), ('fs', 'followed_by_sometimes'), ('fn', 'followed_by_never'), ('pa', 'preceded_by_always'), ('ps', 'preceded_by_sometimes'), ('pn', 'preceded_by_never')))}
FROM sided JOIN ends USING (w) GROUP BY x_end, side""",
    "config_grid": """SELECT * FROM (SELECT unnest(['fixed', 'adaptive']) AS window_generator_type), (SELECT unnest([100, 150, 200]) AS window_size), (SELECT 0.05::DOUBLE AS threshold), (SELECT 300 AS max_distance),
(SELECT unnest([10, 20]) AS slide_by), (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS proportional_phi), (SELECT 0.1::DOUBLE AS proportional_rho)""",
    "true_change_points": f"WITH n AS (SELECT count(*) AS n FROM orders), {_TENTHS} SELECT * FROM tenths",
    "time_window_traces": f"""WITH {_USERS}, lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM ev), win AS (SELECT t_start, t_start + INTERVAL 5 DAY AS t_end FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 5 DAY)) AS t_start, hi FROM lim) WHERE t_start + INTERVAL 5 DAY <= hi),
span AS (SELECT trace_idx, min(ts) AS a, max(ts) AS b FROM ev GROUP BY trace_idx),
hit AS (SELECT 'all_events' AS criterion, t_start, trace_idx, ts FROM ev JOIN win ON ts BETWEEN t_start AND t_end
  UNION ALL SELECT 'all_traces', t_start, trace_idx, ts FROM ev JOIN span USING (trace_idx) JOIN win ON a <= t_end AND b >= t_start
  UNION ALL SELECT 'all_complete_traces', t_start, trace_idx, ts FROM ev JOIN span USING (trace_idx) JOIN win ON a >= t_start AND b <= t_end)
SELECT criterion, epoch_us(t_start) AS w, count(*) AS events, count(DISTINCT trace_idx) AS traces FROM hit GROUP BY ALL""",
    "time_change_series": f"""WITH {_DAYS}, lim AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM ev), {_TIMES.format(size=5 * 86_400_000_000, slide=86_400_000_000)},
e0 AS (SELECT trace_idx, activity, epoch_us(ts) AS u, event_idx FROM ev), sp AS (SELECT trace_idx, min(u) AS a, max(u) AS b, arg_min(activity, event_idx) AS activity FROM e0 GROUP BY trace_idx),
h AS (SELECT 'all_events' AS detector, k, x_end, activity AS value, count(*) FILTER (u < b0) AS o1, count(*) FILTER (u >= b0) AS o2 FROM e0 JOIN grid ON u >= a0 AND u < x_end GROUP BY ALL
  UNION ALL SELECT 'all_traces', k, x_end, activity, count(*) FILTER (a < b0 AND b >= a0), count(*) FILTER (a < x_end AND b >= b0) FROM sp JOIN grid ON a < x_end AND b >= a0 GROUP BY ALL
  UNION ALL SELECT 'all_complete_traces', k, x_end, activity, count(*) FILTER (a >= a0 AND b < b0), count(*) FILTER (a >= b0 AND b < x_end) FROM sp JOIN grid ON a >= a0 AND b < x_end WHERE b < b0 OR a >= b0 GROUP BY ALL
), {_EXPECTED}, {_MOVED}, {_scored(_G, 0)} SELECT detector AS criterion, x_end, round(statistic, 6) AS statistic, dof, round(value, 6) AS value FROM series""",
    "time_explanations": f"""WITH {_DAYS}, lim AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM ev), {_TIMES.format(size=4 * 86_400_000_000, slide=6 * 3_600_000_000)},
tenths AS (SELECT lo + (hi - lo) * i // 4 AS change_point FROM lim, range(1, 4) r(i)),
v AS (SELECT epoch_us(ts) AS u, CASE WHEN epoch_us(ts) >= (lo + hi) // 2 AND epoch_us(ts) % 10 < 7 THEN 'other' ELSE activity END AS value FROM ev, lim),
h AS (SELECT 'event: activity' AS detector, k, x_end, value, count(*) FILTER (u < b0) AS o1, count(*) FILTER (u >= b0) AS o2 FROM v JOIN grid ON u >= a0 AND u < x_end GROUP BY ALL),
{_EXPECTED}, {_MOVED}, {_scored(_G).replace('range(0, 400)', 'range(0, 1600)')}, {_POINTS.replace('0.05', '0.01').replace('gap <= 2', 'gap <= 1').replace('>= 5', '>= 2').replace('FROM series WHERE', 'FROM series WHERE EXISTS (SELECT 1 FROM tenths t WHERE abs(series.x_end - t.change_point) <= 604800000000) AND')},
{_EXPLAINED.replace(str(DISTANCE), str(7 * 86_400_000_000))} SELECT * FROM explained""",
    "around_change_point": f"WITH {_T}, {_DRIFT} SELECT detector, coalesce(value, 'None') AS value, count(*) FILTER (trace_idx <= n // 2) AS o1, count(*) FILTER (trace_idx > n // 2) AS o2 FROM v, n WHERE trace_idx BETWEEN n // 2 - {SIZE - 1} AND n // 2 + {SIZE} GROUP BY ALL",
    "ranked_values": f"WITH {_T}, s AS (SELECT CASE WHEN trace_idx <= n // 2 THEN 'before' ELSE 'after' END AS side, CAST(o_totalprice AS DOUBLE) AS p FROM t, n WHERE trace_idx BETWEEN n // 2 - 199 AND n // 2 + 200) SELECT side, CAST(row_number() OVER (PARTITION BY side ORDER BY p) - 1 AS INTEGER) AS rank, round(p, 3) AS value FROM s",
}

_QUERIES = (
    change_series_gtest, change_series_chi2, change_series_hellinger, change_series_ks, phi_change_points, region_change_series, explanations_table, explanations_unrestricted,
    explanations_all_points, explainer_mixed, explainer_mixed_plot, explainer_runs,
    evaluate_explanations, evaluate_single, aggregate_results, activity_counts, causality_followed_by, causality_preceded_by, sna_relations, relation_type_counts,
    bidirectional_relation_counts, relational_entropy, directly_follows, concurrency, runs_by_trace, runs_change_series, entropy_change_series, relation_change_series, relation_counts_by_window,
    activity_sequences, value_distribution, rolling_mean_filled, open_order_ratio, value_counts, value_counts_before_after, describe_before_after, correlation_pairs,
    correlated_columns, top_pvalues, log_stats, attribute_catalog, attribute_whitelist, attribute_presence, config_grid, true_change_points, results_summary,
    results_summary_fixed, results_by_log, adaptive_change_series, adaptive_region_series, hotelling_series, synthetic_drift_recovery, synthetic_truth, time_window_traces, time_change_series, time_explanations,
    around_change_point, point_timestamps, parts_of_log, example_traces, example_events, ranked_values, streaming_change_series,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}
