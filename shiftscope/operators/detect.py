"""Change series, change points and their explanation."""

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.operators.compare import g_test, ks_series
from shiftscope.operators.histogram import paired_counts


def change_series(values: DataFrame, grid: DataFrame, compare: Callable[[DataFrame], DataFrame], pane: int = 1) -> DataFrame:
    """(detector, pos, x_end, value): the comparison of each pair of windows, for all detectors at once."""
    scored = compare(paired_counts(values, grid, pane))
    return scored.select("detector", F.col("k").alias("pos"), "x_end", "value")


def attribute_series(categorical: DataFrame, continuous: DataFrame, grid: DataFrame, pane: int = 1, min_samples: float = 5) -> DataFrame:
    """G-tests of the categorical attributes and Kolmogorov-Smirnov tests of the continuous ones."""
    left = change_series(categorical, grid, lambda c: g_test(c, min_samples), pane)
    right = ks_series(continuous, grid).select("detector", F.col("k").alias("pos"), "x_end", "value")
    return left.unionByName(right)


#: Positions of a series that one task looks at.
BLOCK = 65_536


def streaks(series: DataFrame, threshold: Column | float, phi: Column | int, rho: Column | int, keys: Sequence[str] = ("detector",)) -> DataFrame:
    """(keys, change_point): the first x_end of each streak of phi values at or below threshold.

    Streaks bridge gaps of up to rho other values; undefined values are other values. Streaks are islands of positions.
    Positions are dealt to blocks, whose last positions below and numbers of new islands are carried on from block to
    block, so no task holds a whole series. threshold, phi and rho may be columns that are constant by keys.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    below = series.filter(F.coalesce(F.col("value") <= lit(threshold), F.lit(False)))
    below = below.select(*keys, "pos", "x_end", lit(phi).alias("__phi"), lit(rho).alias("__rho"), F.floor(F.col("pos") / BLOCK).alias("__block"))
    own = [*keys, "__block"]
    blocks = Window.partitionBy(*keys).orderBy("__block")
    last = below.groupBy(*own).agg(F.max("pos").alias("__last")).withColumn("__last", F.lag("__last").over(blocks))
    order = Window.partitionBy(*own).orderBy("pos")
    carried = _same(below, last, own)
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(order), F.col("__last")) - 1
    islands = carried.withColumn("__new", F.when(gap <= F.col("__rho"), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = islands.groupBy(*own).agg(F.sum("__new").alias("__before")).withColumn("__before", F.coalesce(F.sum("__before").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = _same(islands, before, own).withColumn("__island", F.col("__island") + F.col("__before"))
    found = numbered.groupBy(*keys, "__island").agg(F.count(F.lit(1)).alias("n"), F.max("__phi").alias("__phi"), F.min_by("x_end", "pos").alias("change_point"))
    return found.filter(F.col("n") >= F.col("__phi")).select(*keys, "change_point")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys))


def change_points(series: DataFrame, threshold: float, phi: int, rho: int = 0, reset_per_region: bool = False) -> DataFrame:
    """(detector, change_point) by streaks(). With reset_per_region a streak ends with its region (column region of series)."""
    if phi < 1:
        raise ValueError("phi must be 1 at least")
    keys = ["detector", "region"] if reset_per_region else ["detector"]
    return streaks(series, threshold, phi, rho, keys).select("detector", "change_point")


def phi_rho(size: int, slide: int, proportional_phi: float, proportional_rho: float) -> tuple[int, int]:
    return math.ceil(proportional_phi * size / slide), math.ceil(proportional_rho * size / slide)


def known_points(spark, points: Sequence[int], name: str = "known") -> DataFrame:
    """A detector that is always right."""
    return spark.createDataFrame([(name, int(p)) for p in points], "detector string, change_point long")


def tenths(spark, n_traces: int) -> DataFrame:
    """(i, change_point): the nine tenths of a log."""
    return spark.range(1, 10).select(F.col("id").cast("int").alias("i"), F.floor(F.col("id") * n_traces / 10).cast("long").alias("change_point"))


def explanations(primary: DataFrame, secondary: DataFrame, max_distance: int | None = None, keep_unexplained: bool = False) -> DataFrame:
    """(primary_cp, rank, detector, secondary_cp, lag): secondary change points near each primary one, nearest first.

    With a distance the join is on distance-wide bins, each point meeting three, so no pair beyond them is formed. Without
    one every secondary change point explains every primary one: that is what the option asks for, and its output.
    """
    p = primary.select(F.col("change_point").alias("primary_cp")).distinct()
    s = secondary.select("detector", F.col("change_point").alias("secondary_cp"))
    lag = (F.col("secondary_cp") - F.col("primary_cp")).cast("long")
    if max_distance is None:
        met = p.join(s, F.lit(True))
    else:
        width = max(1, max_distance)
        binned = p.withColumn("bin", F.explode(F.array(*[F.floor(F.col("primary_cp") / width) + i for i in (-1, 0, 1)])))
        met = binned.join(s.withColumn("bin", F.floor(F.col("secondary_cp") / width)), "bin").filter(F.abs(lag) <= max_distance).drop("bin")
    order = Window.partitionBy("primary_cp").orderBy(F.abs("lag"), "secondary_cp", "detector")
    ranked = met.withColumn("lag", lag).withColumn("rank", F.row_number().over(order)).select("primary_cp", "rank", "detector", "secondary_cp", "lag")
    return p.join(ranked, "primary_cp", "left") if keep_unexplained else ranked


def timestamps(points: DataFrame, events: DataFrame, column: str = "change_point") -> DataFrame:
    """points with ts, the time of the first event of the trace at each change point (NULL beyond the log)."""
    first = events.filter("event_idx = 0").select(F.col("trace_idx").alias(column), "ts")
    return points.join(first, column, "left")


def log_parts(n_traces: int, parts: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end), both inclusive, of parts of nearly equal size; each but the first begins `overlap` traces early.

    A memory limit of an external detector asks for this; Spark itself needs no parts.
    """
    edges = [i * n_traces // parts for i in range(parts + 1)]
    return [(max(0, a - (overlap if i else 0)), b - 1) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def in_parts(spark, traces: DataFrame, parts: Sequence[tuple[int, int]]) -> DataFrame:
    """traces with part and part_idx, their place in it; traces of an overlap are in two parts."""
    # one row a part
    spans = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(parts)], "part int, start long, stop long")
    return traces.join(F.broadcast(spans), F.col("trace_idx").between(F.col("start"), F.col("stop"))).withColumn("part_idx", F.col("trace_idx") - F.col("start")).drop("start", "stop")


def absolute_points(spark, points: DataFrame, parts: Sequence[tuple[int, int]]) -> DataFrame:
    """(change_point) of the whole log from (part, change_point) of its parts; found twice in an overlap, it is one."""
    spans = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(parts)], "part int, start long")
    return points.join(F.broadcast(spans), "part").select((F.col("change_point") + F.col("start")).alias("change_point")).distinct()


def flattened(explained: DataFrame) -> DataFrame:
    """(change_point, detector) of all explanations, once for each primary change point."""
    return explained.select(F.col("secondary_cp").alias("change_point"), "detector")


def plot_data(series: DataFrame, points: DataFrame, primary: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(detector, x_end, value, is_cp, is_primary) of a stretch of the series."""
    marked = series.join(points.select("detector", F.col("change_point").alias("x_end"), F.lit(True).alias("is_cp")), ["detector", "x_end"], "left")
    marked = marked.join(primary.select(F.col("change_point").alias("x_end"), F.lit(True).alias("is_primary")).distinct(), "x_end", "left")
    if low is not None:
        marked = marked.filter(F.col("x_end") >= low)
    if high is not None:
        marked = marked.filter(F.col("x_end") <= high)
    return marked.select("detector", "x_end", "value", F.coalesce("is_cp", F.lit(False)).alias("is_cp"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
