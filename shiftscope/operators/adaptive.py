"""Windows whose size follows the variety of what they hold, over a whole log or within regions around change points.

After each pair the number v of distinct values in both windows is taken; the next size is the size times v over the
one before, rounded half to even, and the offset stays. Within regions the first pair of a region begins at
max(0, start - 2 * size + 1) with the size of that moment; the size goes back to the initial one where a region does not
overlap the one before it, and v is kept. Pairs that end at the same trace are one: the last one counts, at the place of
the first.

The recursion needs one pass in trace order: traces are sorted in runs, runs are dealt by detector, and a task keeps the traces that the
next pairs can reach. With regions only the traces near them are dealt.
"""

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.session import ship

MISSING = "\x00missing"
#: Traces before a region that its windows can reach, in initial sizes. A walk that needs older ones raises an error.
REACH = 16
ROWS = 20_000
#: Traces that come to the walk as one row.
RUN = 4_096


class _Traces:
    """The values of traces, as numbers by position, read forward from chunks (position of each value, value) in order of traces."""

    def __init__(self, chunks: Iterator[tuple[pa.Array, pa.Array]]):
        self.chunks, self.base, self.top = chunks, None, -1
        self.at, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts, self.numbers = np.zeros(0, object), {}

    def _read(self) -> tuple[np.ndarray, np.ndarray] | None:
        chunk = next(self.chunks, None)
        if chunk is None:
            return None
        coded, n = chunk[1].dictionary_encode(), len(self.numbers)
        own = np.array([self.numbers.setdefault(v, len(self.numbers)) for v in coded.dictionary.to_pylist()], np.int64)
        if len(self.numbers) > n:
            self.texts = np.array([*self.numbers], object)
        return chunk[0].to_numpy(), own[coded.indices.to_numpy()]

    def reach(self, high: int) -> bool:
        """Whether the log has a trace at high or beyond it; it is read up to there."""
        parts = [(self.at, self.value)]
        while self.top < high:
            chunk = self._read()
            if chunk is None:
                break
            if self.base is None or self.at.size + sum(len(p[0]) for p in parts[1:]) == 0:
                self.base = int(chunk[0][0])
            parts.append(chunk)
            self.top = int(chunk[0][-1])
        if len(parts) > 1:
            self.at, self.value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return self.top >= high

    def check(self, low: int, dealt: int) -> None:
        if low < max(self.base, dealt):
            raise ValueError(f"adaptive windows reach back to trace {low}, traces from {max(self.base, dealt)} on are at hand: raise reach")

    def forget(self, below: int) -> None:
        if self.base is not None and self.base < below:
            kept = np.searchsorted(self.at, below)
            self.at, self.value, self.base = self.at[kept:], self.value[kept:], below
        if len(self.numbers) > 2 * len(self.at) + NAMES:
            # values that have passed are forgotten
            used, self.value = np.unique(self.value, return_inverse=True)
            self.texts = self.texts[used]
            self.numbers = {v: i for i, v in enumerate(self.texts.tolist())}


#: Pairs of one size that are counted at a time, and the cells that they may take.
AHEAD, AHEAD_CELLS = 1 << 12, 1 << 22
#: Values that are numbered at once, beside twice those of the traces at hand.
NAMES = 1 << 16


def _walk(traces: _Traces, regions: list[tuple[int, int | None]], size: int, offset: int, slide: int, least: int, reach: int) -> Iterator[tuple]:
    """(k, region, x_end, values, first counts, second counts) of all pairs; a region without an end ends with the log.

    The pairs that would follow if the size stayed are counted together; those after the first one that changes it are counted again.
    """
    now, variety, k, last_end, ahead = size, None, 0, None, 1
    dealt, dealt_to = 0, -1
    for region, (begin, end) in enumerate(regions):
        if last_end is not None and last_end > begin:
            begin = last_end
        else:
            now = size
        last_end = end
        if end is not None:
            # traces from dealt on are at hand without a gap
            low = max(0, (regions[region][0] - reach) // size * size)
            dealt = dealt if low <= dealt_to + 1 else low
            dealt_to = (end // size + 1) * size - 1
        start = max(0, begin - 2 * now + 1)
        while end is None or start + offset + now - 1 <= end:
            span = max(offset, 0) + now
            if not traces.reach(start + span - 1):
                break
            traces.check(start + min(offset, 0), dealt)
            n = ahead if end is None else min(ahead, (end - (start + offset + now - 1)) // slide + 1)
            traces.reach(start + (n - 1) * slide + span - 1)
            n = min(n, (traces.top - (start + span - 1)) // slide + 1)
            starts = start + np.arange(n) * slide
            inside = slice(np.searchsorted(traces.at, start + min(offset, 0)), np.searchsorted(traces.at, starts[-1] + span))
            values, codes = np.unique(traces.value[inside], return_inverse=True)
            texts = traces.texts[values]
            while n > 1 and n * max(1, len(values)) > AHEAD_CELLS:
                n //= 2
            starts = starts[:n]
            first, second = (_window_counts(traces.at[inside], codes, len(values), starts + o, now) for o in (0, offset))
            variety_of = np.maximum(1, ((first + second) > 0).sum(axis=1))
            same = variety_of == variety
            same[1:] &= variety_of[1:] == variety_of[:-1]
            taken = n if same.all() else int(np.argmin(same)) + 1
            for i in range(taken):
                held = np.flatnonzero(first[i] + second[i])
                yield k + i, region, int(starts[i]) + offset + now - 1, texts[held], first[i][held], second[i][held]
            ahead = min(AHEAD, 2 * ahead) if taken == n else max(1, taken)
            v = int(variety_of[taken - 1])
            if variety is not None:
                now = max(least, round(now * v / variety))
            variety, k, start = v, k + taken, start + taken * slide
            traces.forget(start - (0 if end is None else reach))


def _window_counts(at: np.ndarray, codes: np.ndarray, n_codes: int, starts: np.ndarray, size: int) -> np.ndarray:
    """How often each code is in each window of a size, as a matrix."""
    counts = np.zeros((len(starts), n_codes), np.int64)
    for c in range(n_codes) if n_codes <= 64 else ():
        own = at[codes == c]
        counts[:, c] = np.searchsorted(own, starts + size) - np.searchsorted(own, starts)
    if n_codes > 64:
        for i, (a, b) in enumerate(zip(np.searchsorted(at, starts), np.searchsorted(at, starts + size), strict=True)):
            counts[i] = np.bincount(codes[a:b], minlength=n_codes)
    return counts


def _distinct_ends(pairs: Iterator[tuple], bounds: bool, least: int, offset: int, slide: int) -> Iterator[tuple]:
    """Pairs that end at the same trace as one: the last one, at the place of the first. Places count distinct ends.

    Over a whole log (bounds) a later pair ends after its start at least, so an end before that is held no longer.
    """
    held: dict[int, tuple] = {}
    places, most = 0, 1024
    for k, region, x_end, *counts in pairs:
        if x_end in held:
            place = held[x_end][0]
        else:
            place, places = places, places + 1
        held[x_end] = (place, region, x_end, *counts)
        if bounds and len(held) >= most:
            safe = k * slide + offset + least - 1
            for old in [e for e in held if e < safe]:
                yield held.pop(old)
            most = 2 * len(held) + 1024
    yield from held.values()


def adaptive_counts(
    values: DataFrame, size: int, slide: int = 1, offset: int | None = None, least: int = 2, *, change_points: DataFrame | None = None, max_distance: int | None = None, reach: int = REACH
) -> DataFrame:
    """The paired histogram (detector, k, region, x_end, value, o1, o2) of adaptive windows over (detector, trace_idx, value).

    With change points, windows run within max_distance of them. k numbers the pairs of a detector without gaps.
    """
    spark = values.sparkSession
    ship(spark)
    offset = size if offset is None else offset
    own, regions = values.select("detector", "trace_idx", values["value"].cast("string").alias("value")), [(0, None)]
    if change_points is not None:
        # change points are few: they are the result of a detection
        near = sorted(r[0] for r in change_points.select("change_point").collect())
        regions = [(max(0, p - max_distance), p + max_distance) for p in near]
        if not regions:
            own = own.limit(0)
        else:
            spans = spark.createDataFrame([(a - reach * size, b) for a, b in regions], "low long, high long")
            blocks = spans.select(F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))).alias("__b")).distinct()
            own = own.withColumn("__b", F.floor(F.col("trace_idx") / size)).join(F.broadcast(blocks), "__b").drop("__b")
    # traces come in runs, each sorted by a task of its own; the walk reads the runs in order
    at, run = F.col("trace_idx").cast("long"), F.floor(F.col("trace_idx") / RUN)
    runs = own.filter("trace_idx is not null").groupBy("detector", run.alias("run")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.coalesce("value", F.lit(MISSING)).alias("value")))).alias("cells"))
    ordered = runs.select("detector", "run", F.col("cells.at").alias("at"), F.col("cells.value").alias("value")).repartition("detector").sortWithinPartitions("detector", "run")

    whole = change_points is None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[i].as_py(), b.column(2)[i].values, b.column(3)[i].values) for b in batches for i in range(b.num_rows))
        for detector, mine in groupby(rows, key=itemgetter(0)):
            pairs = _walk(_Traces((at, value) for _, at, value in mine), regions, size, offset, slide, least, reach * size)
            out: list[tuple] = []
            for pair in _distinct_ends(pairs, whole, min(size, least), offset, slide):
                out.append(pair)
                if len(out) >= ROWS:
                    yield _batch(detector, out)
                    out = []
            if out:
                yield _batch(detector, out)

    return ordered.mapInArrow(walk, "detector string, k long, region int, x_end long, value string, o1 long, o2 long")


def _batch(detector: str, pairs: list[tuple]) -> pa.RecordBatch:
    lengths = [len(p[3]) for p in pairs]
    k, region, x_end = (np.repeat(np.array([p[i] for p in pairs], np.int64), lengths) for i in (0, 1, 2))
    value, first, second = (np.concatenate([p[i] for p in pairs]) for i in (3, 4, 5))
    value[value == MISSING] = None
    columns = [pa.array([detector], pa.string()).take(pa.array(np.zeros(len(k), np.int64))), pa.array(k), pa.array(region.astype(np.int32)), pa.array(x_end), pa.array(value, pa.string()), pa.array(first), pa.array(second)]
    return pa.RecordBatch.from_arrays(columns, ["detector", "k", "region", "x_end", "value", "o1", "o2"])
