"""Time windows over events: which traces or events belong to a window, and change series over pairs of windows."""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.operators.detect import explanations
from shiftscope.operators.grid import fixed_grid
from shiftscope.operators.histogram import paired_counts, running_counts, window_bounds
from shiftscope.session import written


def time_grid(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """(w, t_start, t_end inclusive): windows of an interval's length from the first event on, that end within the log."""
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    step = f"INTERVAL {slide or size}"
    starts = span.select("hi", F.explode(F.sequence("lo", "hi", F.expr(step))).alias("t_start"))
    whole = starts.withColumn("t_end", F.col("t_start") + F.expr(f"INTERVAL {size}")).filter("t_end <= hi")
    return whole.select(F.unix_micros(F.col("t_start").cast("timestamp")).alias("w"), "t_start", "t_end")


def members(events: DataFrame, windows: DataFrame, criterion: str = "all_events") -> DataFrame:
    """(w, and the columns of events): all_events in the window, all_traces that touch it, or all_complete_traces in it.

    Windows and times are dealt to days, so that they meet by equality and not all with all.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    spread = windows.withColumn("__day", F.explode(F.sequence(day("t_start"), day("t_end"))))
    hit = events.withColumn("__day", day("ts")).join(spread, "__day").filter("ts BETWEEN t_start AND t_end").drop("__day")
    if criterion == "all_events":
        return hit.drop("t_start", "t_end")
    spans = events.groupBy("trace_idx").agg(F.min("ts").alias("__lo"), F.max("ts").alias("__hi"))
    if criterion == "all_complete_traces":
        inside = hit.select("w", "trace_idx", "t_start", "t_end").distinct().join(spans, "trace_idx").filter("__lo >= t_start AND __hi <= t_end")
    elif criterion == "all_traces":
        days = spans.withColumn("__day", F.explode(F.sequence(day("__lo"), day("__hi"))))
        inside = days.join(spread, "__day").filter("__lo <= t_end AND __hi >= t_start").select("w", "trace_idx").distinct()
    else:
        raise ValueError(f"unknown criterion {criterion}")
    return events.join(inside.select("w", "trace_idx"), "trace_idx")


@dataclass(frozen=True)
class TimeWindows:
    """Pairs of windows over time: the second begins offset (the size, if none is given) after the first, pairs every slide.

    Windows hold their start and not their end. criterion says what is in one: all_events that happen in it, all_traces that touch it, or
    all_complete_traces that begin and end in it.
    """

    size: timedelta
    slide: timedelta
    offset: timedelta | None = None
    criterion: str = "all_events"

    @property
    def micros(self) -> tuple[int, int, int]:
        own = (self.size, self.slide, self.size if self.offset is None else self.offset)
        return tuple(x // timedelta(microseconds=1) for x in own)

    @property
    def tick(self) -> int:
        """The longest unit, in microseconds, that all bounds are multiples of: the panes of these windows."""
        return gcd(*self.micros)


@dataclass(frozen=True)
class TimeAxis:
    """Times as whole ticks since an origin: grids, histograms and series over positions serve for times as they are."""

    origin: int
    ticks: int
    tick: int

    @classmethod
    def of(cls, events: DataFrame, windows: TimeWindows) -> "TimeAxis":
        first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
        return cls(first or 0, 0 if first is None else (last - first) // windows.tick + 1, windows.tick)

    def place(self, time: Column) -> Column:
        return F.floor((F.unix_micros(time.cast("timestamp")) - self.origin) / self.tick)

    def end(self, place: Column) -> Column:
        """The time, in microseconds, at which a place ends."""
        return F.lit(self.origin) + (place + 1) * self.tick

    def grid(self, spark, windows: TimeWindows) -> DataFrame:
        size, slide, offset = (x // self.tick for x in windows.micros)
        return fixed_grid(spark, self.ticks, size, offset, slide)


def paired_by_time(values: DataFrame, grid: DataFrame, axis: TimeAxis, criterion: str = "all_events") -> DataFrame:
    """paired_counts() over a grid of an axis: values is (detector, value, ts) for all_events, else (detector, value, lo, hi), the times of a trace's first and last event.

    Traces that touch a window are those that begin before its end less those that end before its start, two running sums.
    Traces within one are counted by first and last tick, and met by the first one.
    """
    if criterion == "all_events":
        return paired_counts(values.select("detector", axis.place(F.col("ts")).alias("trace_idx"), "value"), grid)
    if criterion not in ("all_traces", "all_complete_traces"):
        raise ValueError(f"unknown criterion {criterion}")
    low, high = axis.place(F.col("lo")).alias("low"), axis.place(F.col("hi")).alias("high")
    spans = written(values.select("detector", "value", low, high).groupBy("detector", "value", "low", "high").agg(F.count(F.lit(1)).alias("n")), "time-spans")
    if criterion == "all_complete_traces":
        window = lambda first, side: F.struct(F.lit(first).alias("first"), F.col(f"{side}_end").alias("end"), F.sequence(f"{side}_start", f"{side}_end").alias("places"))
        each = grid.select("k", F.col("b_end").alias("x_end"), F.explode(F.array(window(1, "a"), window(0, "b"))).alias("w"))
        spread = each.select("k", "x_end", "w.first", "w.end", F.explode("w.places").alias("low"))
        met = spans.join(spread, "low").filter(F.col("high") <= F.col("end"))
        return met.groupBy("detector", "k", "x_end", "value").agg(F.sum(F.col("n") * F.col("first")).alias("o1"), F.sum(F.col("n") * (1 - F.col("first"))).alias("o2"))
    bounds = window_bounds(grid)
    cuts, both = bounds.select("cut").distinct(), []
    for place, sign in (("low", 1), ("high", -1)):
        counts = spans.groupBy("detector", "value", F.col(place).alias("slot")).agg(F.sum("n").alias("n"))
        both.append(running_counts(counts, cuts).withColumn("sign", F.lit(sign)))
    met = bounds.join(both[0].unionByName(both[1]), ["cut", "sign"])
    side = lambda first: F.sum(F.when(F.col("first") == first, F.col("sign") * F.col("upto")).otherwise(0))
    return met.groupBy("detector", "k", "x_end", "value").agg(side(1).alias("o1"), side(0).alias("o2")).filter("o1 + o2 > 0")


def time_series(values: DataFrame, events: DataFrame, windows: TimeWindows, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(detector, pos, x_end, value): the change series over pairs of time windows; x_end is the time, in microseconds, at which a pair ends."""
    axis = TimeAxis.of(events, windows)
    scored = compare(paired_by_time(values, axis.grid(values.sparkSession, windows), axis, windows.criterion))
    others = [c for c in ("statistic", "dof") if c in scored.columns]
    return scored.select("detector", F.col("k").alias("pos"), axis.end(F.col("x_end")).alias("x_end"), *others, "value")


def trace_spans(events: DataFrame) -> DataFrame:
    """(trace_idx, lo, hi): the times of each trace's first and last event."""
    return events.groupBy("trace_idx").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def time_explanations(primary: DataFrame, secondary: DataFrame, max_distance: timedelta | None = None) -> DataFrame:
    """explanations() of points in time, (detector, change_point) in microseconds; lags are microseconds, a distance is an interval."""
    return explanations(primary, secondary, None if max_distance is None else max_distance // timedelta(microseconds=1))
