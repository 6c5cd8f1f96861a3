"""Detectors of change with one interface, and the explainer that sets them against each other.

A detector has a name and gives Changes for an EventLog, for the whole log or around given change points. The explainer
runs a primary detector (known points, or a control-flow feature), then secondary detectors over any mix of categorical
and continuous attributes, within a distance of the primary change points if one is given, and joins what they found.
The primary change points are computed once, when an explanation is asked for; detectors are rows of one plan, not loops of it.
"""

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.operators import adaptive, controlflow, detect
from shiftscope.operators.compare import g_test, ks_series, ks_test
from shiftscope.operators.grid import fixed_grid, region_grid
from shiftscope.operators.histogram import paired_counts
from shiftscope.operators.timewindows import TimeWindows, time_series, trace_spans
from shiftscope.schema import Attribute
from shiftscope.session import written
from shiftscope.sources.tables import long_values


@dataclass
class EventLog:
    """Traces (trace_idx and attributes as columns), events (trace_idx, event_idx, activity and attributes), and their number."""

    traces: DataFrame
    n_traces: int
    events: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.traces.sparkSession

    def values(self, attributes: Sequence[Attribute], kind: str) -> DataFrame:
        """(detector, trace_idx, value) of attributes of traces and of events; a trace has a row for each of its events."""
        found = []
        for level, frame in (("trace", self.traces), ("event", self.events)):
            own = [a.name for a in attributes if a.level == level]
            if own:
                found.append(long_values(frame, own, level, kind))
        return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class Windows:
    size: int
    slide: int = 1
    offset: int | None = None
    adaptive: bool = False
    least: int = 2

    def grid(self, log: EventLog, around: DataFrame | None, max_distance: int | None) -> DataFrame:
        if around is None:
            return fixed_grid(log.spark, log.n_traces, self.size, self.offset, self.slide)
        return region_grid(around, log.n_traces, self.size, max_distance, self.offset, self.slide)

    def pane(self, around: DataFrame | None) -> int:
        from shiftscope.operators.grid import pane_size

        # regions begin anywhere, so their windows have single traces for panes
        return 1 if around is not None else pane_size(self.size, self.size if self.offset is None else self.offset, self.slide)


@dataclass(frozen=True)
class Streaks:
    """How change points are taken from a series."""

    threshold: float
    phi: int
    rho: int = 0
    reset_per_region: bool = False

    def points(self, series: DataFrame) -> DataFrame:
        return detect.change_points(series, self.threshold, self.phi, self.rho, self.reset_per_region)


@dataclass
class Changes:
    """The series of a detection, (detector, pos, region, x_end, value), or None, and its (detector, change_point)."""

    points: DataFrame
    series: DataFrame | None = None

    def summary(self) -> str:
        rows = self.points.groupBy("detector").agg(F.sort_array(F.collect_list("change_point")).alias("p")).orderBy("detector").collect()
        return "\n".join(f"{r.detector}: {len(r.p)} change points at {', '.join(map(str, r.p))}" for r in rows) or "no change points"


class Detector(Protocol):
    def names(self) -> list[str]: ...

    def changes(self, log: EventLog, around: DataFrame | None = None, max_distance: int | None = None, unit: str = "trace") -> Changes: ...


def _only_traces(unit: str) -> None:
    if unit != "trace":
        raise NotImplementedError(f"unit of measure {unit}: distances are counted in traces")


@dataclass
class KnownPoints:
    """A detector that is always right."""

    change_points: Sequence[int]
    name: str = "known"

    def names(self) -> list[str]:
        return [self.name]

    def changes(self, log: EventLog, around: DataFrame | None = None, max_distance: int | None = None, unit: str = "trace") -> Changes:
        return Changes(detect.known_points(log.spark, self.change_points, self.name))


def _scored(scored: DataFrame, regions: DataFrame | None) -> DataFrame:
    scored = scored.select("detector", F.col("k").alias("pos"), "x_end", "value")
    if regions is None:
        return scored.withColumn("region", F.lit(0))
    return scored.join(regions.select(F.col("k").alias("pos"), "region").distinct(), "pos")


@dataclass
class AttributeDetectors:
    """Hypothesis tests of attributes: G-tests of categorical ones, Kolmogorov-Smirnov tests of continuous ones.

    categorical takes another comparison in place of the G-test: chi_squared, hellinger, or the caller's own, from the paired
    histogram (detector, k, x_end, value, o1, o2) to a value for each pair.
    """

    attributes: Sequence[Attribute]
    windows: Windows
    streaks: Streaks
    min_samples_per_test: float = 5
    categorical: Callable[[DataFrame], DataFrame] | None = None

    def names(self) -> list[str]:
        return [a.detector for a in self.attributes]

    def changes(self, log: EventLog, around: DataFrame | None = None, max_distance: int | None = None, unit: str = "trace") -> Changes:
        _only_traces(unit)
        w, grid, found = self.windows, None, []
        if not w.adaptive:
            grid, pane = w.grid(log, around, max_distance), w.pane(around)
        for kind, cast, test in (("categorical", "string", self.categorical or (lambda c: g_test(c, self.min_samples_per_test))), ("continuous", "double", ks_test)):
            own = [a for a in self.attributes if a.kind == kind]
            if not own:
                continue
            values = log.values(own, cast)
            if w.adaptive:
                counts = adaptive.adaptive_counts(values, w.size, w.slide, w.offset, w.least, change_points=around, max_distance=max_distance)
                regions = counts.select("detector", F.col("k").alias("pos"), "region").distinct()
                found.append(test(counts).select("detector", F.col("k").alias("pos"), "x_end", "value").join(regions, ["detector", "pos"]))
            else:
                scored = test(paired_counts(values, grid, pane)) if kind == "categorical" else ks_series(values, grid)
                found.append(_scored(scored, grid if around is not None else None))
        series = reduce(DataFrame.unionByName, found)
        return Changes(self.streaks.points(series), series)


def attribute_detectors(
    attributes: Sequence[Attribute], windows: Windows, streaks: Streaks, min_samples_per_test: float = 5, categorical: Callable[[DataFrame], DataFrame] | None = None
) -> AttributeDetectors:
    """The detectors of all attributes as one plan. Each adaptive walk is its own; no size leaks from one attribute to another."""
    names = [a.detector for a in attributes]
    if len(set(names)) < len(names):
        raise ValueError("two detectors of one name")
    return AttributeDetectors(attributes, windows, streaks, min_samples_per_test, categorical)


@dataclass
class ControlFlowDetector:
    """Hypothesis tests of a feature of the control flow: runs, relational entropy, or relation type counts."""

    feature: str
    windows: Windows
    streaks: Streaks
    min_samples_per_test: float = 5

    def names(self) -> list[str]:
        return [self.feature]

    def changes(self, log: EventLog, around: DataFrame | None = None, max_distance: int | None = None, unit: str = "trace") -> Changes:
        _only_traces(unit)
        if self.windows.adaptive:
            raise NotImplementedError("a control-flow feature belongs to a window: its windows are fixed")
        grid = self.windows.grid(log, around, max_distance)
        scored = controlflow.feature_series(log.events, grid, self.feature, self.min_samples_per_test, self.windows.pane(around))
        regions = grid.select(F.col("k").alias("pos"), "region")
        series = scored.select("detector", F.col("k").alias("pos"), "x_end", "value").join(regions, "pos")
        return Changes(self.streaks.points(series), series)


@dataclass
class TimeDetector:
    """Hypothesis tests of attributes over pairs of time windows: change points are times, in microseconds, and distances intervals.

    Attributes of events count where they happen; those of traces by the traces that touch a window or lie in it, as the
    windows' criterion says, which is all_traces where it says all_events.
    """

    attributes: Sequence[Attribute]
    windows: TimeWindows
    streaks: Streaks
    min_samples_per_test: float = 5
    categorical: Callable[[DataFrame], DataFrame] | None = None

    def names(self) -> list[str]:
        return [a.detector for a in self.attributes]

    def changes(self, log: EventLog, around: DataFrame | None = None, max_distance: timedelta | None = None, unit: str = "time") -> Changes:
        if unit != "time":
            raise NotImplementedError(f"unit of measure {unit}: these distances are intervals")
        test = {"categorical": self.categorical or (lambda c: g_test(c, self.min_samples_per_test)), "continuous": ks_test}
        found = []
        for level in ("event", "trace"):
            for kind, cast in (("categorical", "string"), ("continuous", "double")):
                own = [a.name for a in self.attributes if (a.level, a.kind) == (level, kind)]
                if not own:
                    continue
                windows = self.windows
                if level == "event":
                    values = long_values(log.events, own, level, cast, keep=("ts",))
                    windows = replace(windows, criterion="all_events")
                else:
                    values = long_values(log.traces, own, level, cast).join(trace_spans(log.events), "trace_idx")
                    if windows.criterion == "all_events":
                        windows = replace(windows, criterion="all_traces")
                found.append(time_series(values, log.events, windows, test[kind]).select("detector", "pos", "x_end", "value"))
        series = reduce(DataFrame.unionByName, found)
        if around is not None:
            width = max(1, max_distance // timedelta(microseconds=1))
            bin_of = lambda c: F.floor(c / width)
            near = around.select(F.col("change_point").alias("p"), F.explode(F.array(*[bin_of(F.col("change_point")) + i for i in (-1, 0, 1)])).alias("bin"))
            close = series.withColumn("bin", bin_of(F.col("x_end"))).join(near, "bin").filter(F.abs(F.col("x_end") - F.col("p")) <= width)
            series = close.select("detector", "pos", "x_end", "value").distinct()
        series = series.withColumn("region", F.lit(0))
        return Changes(self.streaks.points(series), series)


@dataclass
class Explanations:
    primary: Changes
    secondary: Changes
    table: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


@dataclass
class Explainer:
    primary: Detector
    secondary: Sequence[Detector]

    def explain(self, log: EventLog, max_distance: int | timedelta | None = None, timing: bool = False) -> Explanations:
        """Possible explanations of the primary change points: (primary_cp, rank, detector, secondary_cp, lag).

        Distances are counted in traces, or are intervals where all detectors work in time (TimeDetector, and KnownPoints of
        microseconds). With a distance the secondary detectors look around the primary change points only. timing computes the two
        detections one after the other and notes their seconds.
        """
        names = [n for d in self.secondary for n in d.names()]
        if len(set(names)) < len(names):
            raise ValueError("two detectors of one name")
        seconds: dict[str, float] = {}

        def timed(name: str, changes: Changes) -> Changes:
            if timing:
                begin = time.perf_counter()
                changes.points.count()
                seconds[name] = time.perf_counter() - begin
            return changes

        in_time = any(isinstance(d, TimeDetector) for d in (self.primary, *self.secondary))
        unit = "time" if in_time else "trace"
        first = timed("primary", self.primary.changes(log, unit=unit))
        # few points, which the secondary detectors and the explanation both read
        first = Changes(written(first.points, "primary-points"), first.series)
        around = first.points.select("change_point") if max_distance is not None else None
        found = [d.changes(log, around, max_distance, unit) for d in self.secondary]
        series = [c.series for c in found if c.series is not None]
        second = timed("secondary", Changes(reduce(DataFrame.unionByName, [c.points for c in found]), reduce(DataFrame.unionByName, series) if series else None))
        reach = max_distance // timedelta(microseconds=1) if isinstance(max_distance, timedelta) else max_distance
        return Explanations(first, second, detect.explanations(first.points, second.points, reach), seconds)
