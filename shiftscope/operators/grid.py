"""Window-pair grids over trace positions: fixed, restricted to regions, and around one change point."""

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixed_grid(spark: SparkSession, n_traces: int, size: int, offset: int | None = None, slide: int = 1, start: int = 0) -> DataFrame:
    """(region, k, a_start, a_end, b_start, b_end): all pairs whose second window ends within the log."""
    offset = size if offset is None else offset
    pairs = max(0, (n_traces - start - offset - size) // slide + 1)
    a = F.col("k") * slide + start
    grid = spark.range(pairs).withColumnRenamed("id", "k")
    return grid.select(F.lit(0).alias("region"), "k", a.alias("a_start"), (a + size - 1).alias("a_end"), (a + offset).alias("b_start"), (a + offset + size - 1).alias("b_end"))


def region_grid(change_points: DataFrame, n_traces: int, size: int, max_distance: int, offset: int | None = None, slide: int = 1) -> DataFrame:
    """The grid restricted to regions of max_distance around change points (column change_point).

    A region starts where the one before it ends if they overlap. Its first second window ends at the region's start,
    so each region has a slide phase of its own. A pair that two regions share is kept once, at its first place.
    """
    offset = size if offset is None else offset
    # change points are few: they are the result of a detection
    order = Window.orderBy("change_point", "__o")
    cps = change_points.select("change_point", F.monotonically_increasing_id().alias("__o"))
    regions = cps.select(
        (F.row_number().over(order) - 1).cast("int").alias("region"),
        F.greatest(F.lit(0), F.col("change_point") - max_distance).alias("s0"),
        F.least(F.lit(n_traces), F.col("change_point") + max_distance).alias("e"),
    )
    first = F.greatest(F.lit(0), F.col("s") - 2 * size + 1) + offset + size - 1
    last = F.least(F.col("e"), F.lit(n_traces - 1))
    regions = (
        regions.withColumn("s", F.greatest("s0", F.coalesce(F.lag("e").over(Window.orderBy("region")), F.col("s0"))))
        .select("region", first.cast("long").alias("first"), last.cast("long").alias("last"))
        .filter(F.col("first") <= F.col("last"))
    )
    ends = regions.select("region", F.explode(F.sequence("first", "last", F.lit(slide).cast("long"))).alias("b_end"))
    kept = ends.groupBy("b_end").agg(F.min("region").alias("region"))
    k = F.row_number().over(Window.orderBy("region", "b_end")) - 1
    b = F.col("b_end") - size + 1
    return kept.select("region", k.cast("long").alias("k"), (b - offset).alias("a_start"), (b - offset + size - 1).alias("a_end"), b.alias("b_start"), "b_end")


def around(spark: SparkSession, change_point: int, width: int = 200) -> DataFrame:
    """The pair just before and just after one change point; positions before the log simply hold no traces."""
    return spark.createDataFrame(
        [(0, 0, change_point - width + 1, change_point, change_point + 1, change_point + width)],
        "region int, k long, a_start long, a_end long, b_start long, b_end long",
    )


def ranges(grid: DataFrame) -> DataFrame:
    """(w_start, w_end) of the distinct windows of a grid: the first window of one pair is the second of another."""
    return grid.select(F.col("a_start").alias("w_start"), F.col("a_end").alias("w_end")).union(grid.select("b_start", "b_end")).distinct()


def pane_size(size: int, offset: int, slide: int) -> int:
    return gcd(gcd(size, offset), slide)
