"""Sums of counted places over windows, by blocks of places.

Places are dealt to blocks a few times as long as the longest window, or pair of windows. A window is summed in the block
where it begins, so a row goes to its block and the one before: what is shuffled is the table once and a part of it twice, and
not a row for each place of each window. A task holds the rows and windows of one block.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.session import ship

#: Places that one task sums windows in, at least; and the cells that it adds up at a time.
BLOCK = 1 << 10
CELLS = 1 << 20
#: Windows that one partition sums, and then holds the sums of, at most (about; they are dealt by hash), so that tasks over more of them do not grow.
PARTITION_WINDOWS = 50_000
#: Blocks (16 bytes each) that are broadcast to the rows at most.
BROADCAST_BLOCKS = 1_000_000


def _numbered(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each value, NULL being one, and how many there are."""
    if pa.types.is_nested(column.type):
        names, numbers = np.unique(np.array([repr(x) for x in column.to_pylist()], dtype=str), return_inverse=True)
        return numbers.astype(np.int64), len(names)
    own = column.dictionary_encode(null_encoding="encode")
    return own.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(own.dictionary)


def _codes(rows: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, pa.Table]:
    """A number for each row's keys, and the keys of each number."""
    code = np.zeros(len(rows), np.int64)
    for c in keys:
        numbers, n = _numbered(rows.column(c).combine_chunks())
        code = code * max(1, n) + numbers
    _, first, codes = np.unique(code, return_index=True, return_inverse=True)
    return codes, rows.select(list(keys)).take(pa.array(first, pa.int64()))


def sums_of(codes: np.ndarray, n_codes: int, places: np.ndarray, weights: list[np.ndarray], lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(window, code, sums) of each window, low to high with both included, and each code that has rows in it.

    From running sums over places where the codes are few, else from the windows' rows, CELLS at a time.
    """
    order = np.argsort(places, kind="stable")
    places, codes, weights = places[order], codes[order], [w[order] for w in weights]
    seen = np.unique(places)
    start = np.searchsorted(places, lows, side="left")
    length = np.maximum(np.searchsorted(places, highs, side="right") - start, 0)
    whole = lambda x: np.rint(x).astype(np.int64)
    cells = n_codes * (len(seen) + 2 * len(lows))
    if cells <= min(4 * CELLS, 4 * int(length.sum()) + 1024):
        flat = codes * len(seen) + np.searchsorted(seen, places)
        low = np.searchsorted(seen, lows, side="left")
        high = np.maximum(np.searchsorted(seen, highs, side="right"), low)

        def windowed(weight: np.ndarray | None) -> np.ndarray:
            upto = np.zeros((n_codes, len(seen) + 1))
            upto[:, 1:] = np.bincount(flat, weight, minlength=n_codes * len(seen)).reshape(n_codes, len(seen)).cumsum(axis=1)
            return (upto[:, high] - upto[:, low]).T

        window, code = np.nonzero(windowed(None) > 0.5)
        return window, code, [whole(windowed(w)[window, code]) for w in weights]
    parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(weights))]
    upto, i = np.cumsum(length), 0
    while i < len(lows):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CELLS, side="right")))
        own = length[i:j]
        row = np.arange(int(own.sum())) + np.repeat(start[i:j] - (np.cumsum(own) - own), own)
        found, inverse = np.unique(np.repeat(np.arange(i, j), own) * max(1, n_codes) + codes[row], return_inverse=True)
        parts.append((found // max(1, n_codes), found % max(1, n_codes), [whole(np.bincount(inverse, w[row], minlength=len(found))) for w in weights]))
        i = j
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [np.concatenate([p[2][s] for p in parts]) for s in range(len(weights))]


def _summed(names: list[str], keys: list[str], sums: list[str], sides: list[tuple[str, str]], out: list[str]):
    def block(key: tuple, rows: pa.Table, windows: pa.Table) -> pa.Table:
        codes, known = _codes(rows, keys)
        n = max(1, len(known))
        places, weights = rows.column("__place").to_numpy(), [rows.column(c).to_numpy() for c in sums]
        found = []
        for low, high in sides:
            window, code, totals = sums_of(codes, len(known), places, weights, windows.column(low).to_numpy(), windows.column(high).to_numpy())
            found.append((window * n + code, totals))
        cells = np.unique(np.concatenate([f[0] for f in found]))
        columns = [windows.column(c).take(pa.array(cells // n)).combine_chunks() for c in names]
        columns += [known.column(c).take(pa.array(cells % n)).combine_chunks() for c in keys]
        for own, totals in found:
            for total in totals:
                column = np.zeros(len(cells), np.int64)
                column[np.searchsorted(cells, own)] = total
                columns.append(pa.array(column))
        return pa.Table.from_arrays(columns, [*names, *keys, *out])

    return block


def window_totals(counts: DataFrame, windows: DataFrame, names: dict[str, str], sides: dict[tuple[str, str], list[str]], keys: list[str], sums: list[str]) -> DataFrame:
    """(names, keys, sums of each side): for each window, and all keys that have rows in it, the sums of its rows.

    counts is (__place, keys, sums), with any number of rows for a place; a NULL adds nothing. sides are the columns of a window's first and last place,
    each with the names of its sums; with two of them a row is a pair of windows, 0 where only the other one has the keys.
    """
    spark = counts.sparkSession
    ship(spark)
    low, high = (f([F.col(c[i]) for c in sides]) for i, f in ((0, lambda c: F.least(*c) if len(c) > 1 else c[0]), (1, lambda c: F.greatest(*c) if len(c) > 1 else c[0])))
    span, first, last, n = windows.agg(F.max(high - low + 1), F.min(low), F.max(low), F.count(F.lit(1))).first()
    span = max(1, span or 1)
    width = max(BLOCK, 4 * span)
    block = lambda c: F.floor(c / width)
    bounds = [F.col(c).cast("long").alias(c) for side in sides for c in side]
    placed = windows.select(block(low).alias("__block"), *[F.col(c).cast(t).alias(c) for c, t in names.items()], *bounds)
    blocks = placed.select("__block").distinct()
    if not n or (last - first) // width < BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    at = F.col("__place")
    dealt = counts.select(at.cast("long").alias("__place"), *keys, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in sums], F.explode(F.sequence(block(at - (span - 1)), block(at))).alias("__block"))
    dealt = dealt.join(blocks, "__block", "left_semi")
    # adaptive plans merge partitions up to a size in compressed bytes, of which such rows have few: many windows ask for partitions of their own
    parts, session_parts = math.ceil(n / PARTITION_WINDOWS), int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = parts > min(session_parts, spark.sparkContext.defaultParallelism)
    if many:
        dealt, placed = dealt.repartition(parts, "__block"), placed.repartition(parts, "__block")
    met = dealt.groupBy("__block").cogroup(placed.groupBy("__block"))
    out = [c for own in sides.values() for c in own]
    fields = [T.StructField(c, counts.schema[c].dataType) for c in keys]
    schema = T.StructType([*[T.StructField(c, T._parse_datatype_string(t)) for c, t in names.items()], *fields, *[T.StructField(c, T.LongType()) for c in out]])
    found = met.applyInArrow(_summed(list(names), keys, sums, list(sides), out), schema)
    # what follows is by detector and window; sums of other keys are written as they come, unless the session's partitions are too few
    if many and "detector" in keys or parts > session_parts:
        found = found.repartition(parts, *[c for c in ("detector", *names) if c in found.columns])
    return found


def _combined(names: list[str]):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
            yield from pa.Table.from_arrays([*[table.column(c) for c in names], table.column("count_all").cast(pa.int64())], [*names, "n"]).combine_chunks().to_batches()

    return combine


def place_counts(values: DataFrame, pane: int) -> DataFrame:
    """(detector, __place, value, n) from (detector, trace_idx, value): values of a pane that come together are one row, added up as they stream by."""
    kind = values.schema["value"].dataType
    # 0.0 and -0.0 are one value
    value = F.col("value") + F.lit(0.0).cast(kind) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col("value")
    rows = values.select("detector", F.floor(F.col("trace_idx") / pane).alias("__place"), value.alias("value"))
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return rows.withColumn("n", F.lit(1).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])
    return rows.mapInArrow(_combined(rows.columns), schema)
