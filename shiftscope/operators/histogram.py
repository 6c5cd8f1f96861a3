"""Histograms of attribute values by window, from panes that are aggregated once, or from running sums.

Windows that begin and end at multiples of a pane add up their panes. Windows that begin anywhere, as those around change
points do, are differences of running sums: their bounds cut the positions into slots, a trace is counted in its slot,
and each value has a running sum at each cut, which both windows of a pair look up.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.operators.blocks import place_counts, window_totals
from shiftscope.session import written

#: Rows (32 bytes each) that are broadcast to the traces at most; more are joined by shuffle.
BROADCAST_POSITIONS = 1_000_000
#: Positions whose cuts are searched together.
CUT_BLOCK = 64
#: Positions whose running sums are taken in one task; sums of blocks are carried on.
SUM_BLOCK = 1 << 16


def sides(grid: DataFrame, pane: int) -> DataFrame:
    """(k, x_end, first, pane): the panes of both windows of each pair; first is 1 for those of the first window.

    Bounds must be multiples of the pane.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / pane), F.floor(F.col(b) / pane))
    windows = F.array(F.struct(F.lit(1).alias("first"), span("a_start", "a_end").alias("panes")), F.struct(F.lit(0).alias("first"), span("b_start", "b_end").alias("panes")))
    each = grid.select("k", F.col("b_end").alias("x_end"), F.explode(windows).alias("w"))
    spread = each.select("k", "x_end", "w.first", F.explode("w.panes").alias("pane"))
    if pane > 1:
        return spread
    # single positions meet the traces themselves; few of them are sent to where the traces are
    wanted = F.col("a_end") - F.col("a_start") + F.col("b_end") - F.col("b_start") + 2
    n = grid.agg(F.coalesce(F.sum(wanted), F.lit(0))).first()[0]
    return F.broadcast(spread) if n <= BROADCAST_POSITIONS else spread


def paired_rows(values: DataFrame, grid: DataFrame, pane: int = 1) -> DataFrame:
    """(detector, k, x_end, value, o1, o2): a row for each value of a trace in each pair, 1 on its side; for values that seldom repeat."""
    placed = values.select("detector", F.floor(F.col("trace_idx") / pane).alias("pane"), "value")
    met = placed.join(sides(grid, pane), "pane")
    return met.select("detector", "k", "x_end", "value", F.col("first").cast("long").alias("o1"), (1 - F.col("first")).cast("long").alias("o2"))


def window_bounds(grid: DataFrame) -> DataFrame:
    """(k, x_end, first, sign, cut): a window's count is the running sum before the place after its end less that before its start."""
    bound = lambda first, sign, cut: F.struct(F.lit(first).alias("first"), F.lit(sign).alias("sign"), cut.cast("long").alias("cut"))
    four = F.array(bound(1, -1, F.col("a_start")), bound(1, 1, F.col("a_end") + 1), bound(0, -1, F.col("b_start")), bound(0, 1, F.col("b_end") + 1))
    return grid.select("k", F.col("b_end").alias("x_end"), F.inline(four))


def slot_counts(values: DataFrame, grid: DataFrame) -> DataFrame:
    """(detector, value, slot, n): traces between two neighbouring cuts (or block starts) of the grid, named by the first position.

    Blocks without a window are left out before anything is shuffled.
    """
    block = lambda c: F.floor(c / CUT_BLOCK)
    cuts = window_bounds(grid).select("cut").distinct().groupBy(block(F.col("cut")).alias("__block")).agg(F.collect_list("cut").alias("__cuts"))
    spans = grid.select(F.explode(F.array(F.struct("a_start", "a_end"), F.struct(F.col("b_start").alias("a_start"), F.col("b_end").alias("a_end")))).alias("w"))
    held = spans.select(F.explode(F.sequence(block(F.col("w.a_start")), block(F.col("w.a_end")))).alias("__block")).distinct().join(cuts, "__block", "left")
    held = written(held, "slot-blocks")
    if held.count() <= BROADCAST_POSITIONS:
        held = F.broadcast(held)
    at = F.col("trace_idx")
    met = values.select("detector", "value", "trace_idx", block(at).alias("__block")).join(held, "__block")
    slot = F.coalesce(F.array_max(F.filter("__cuts", lambda c: c <= at)), F.col("__block") * CUT_BLOCK)
    return met.groupBy("detector", "value", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def running_counts(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(detector, value, cut, upto): what slot_counts() has before each cut, for each value."""
    keys = counts.select("detector", "value").distinct()
    looked = keys.join(cuts.select(F.col("cut").alias("pos")), F.lit(True)).select("detector", "value", "pos", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))
    both = looked.unionAll(counts.select("detector", "value", F.col("slot").alias("pos"), "n", F.lit(1).alias("kind")))
    both = both.withColumn("block", F.floor(F.col("pos") / SUM_BLOCK))
    inside = Window.partitionBy("detector", "value", "block").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("detector", "value").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("detector", "value", "block").agg(F.sum("n").alias("n")).select("detector", "value", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    summed = both.withColumn("n", F.sum("n").over(inside)).filter("kind = 0").alias("s")
    blocks = blocks.alias("b")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("detector", "value", "block")]
    return summed.join(blocks, same).select("s.detector", "s.value", F.col("s.pos").alias("cut"), (F.col("s.n") + F.col("b.before")).alias("upto"))


def _looked_up(values: DataFrame, grid: DataFrame) -> DataFrame | None:
    """paired_counts() from running sums; None where their rows would be more than those of the windows' traces, as with values that seldom repeat."""
    counts = written(slot_counts(values, grid), "slot-counts")
    cuts = window_bounds(grid).select("cut").distinct()
    wanted = F.col("a_end") - F.col("a_start") + F.col("b_end") - F.col("b_start") + 2
    keys, looks, traces = counts.select("detector", "value").distinct().count(), 4 * grid.count(), grid.agg(F.coalesce(F.sum(wanted), F.lit(0))).first()[0]
    detectors = counts.select("detector").distinct().count()
    if keys * looks > traces * max(1, detectors):
        return None
    met = window_bounds(grid).join(running_counts(counts, cuts), "cut")
    side = lambda first: F.sum(F.when(F.col("first") == first, F.col("sign") * F.col("upto")).otherwise(0))
    return met.groupBy("detector", "k", "x_end", "value").agg(side(1).alias("o1"), side(0).alias("o2")).filter("o1 + o2 > 0")


def paired_counts(values: DataFrame, grid: DataFrame, pane: int = 1) -> DataFrame:
    """(detector, k, x_end, value, o1, o2): counts of each value in both windows of each pair, 0 where absent.

    NULL is a value of its own. Every value has at least one count above 0. Windows are sums of panes, taken by blocks of panes,
    so neither the rows that are moved nor a task's grow with the panes of a window. With single traces for panes they are
    (pairs x values), from running sums, where values repeat.
    """
    if pane == 1:
        found = _looked_up(values, grid)
        if found is not None:
            return found
    return paired_places(place_counts(values, pane), grid, pane)


def paired_places(counts: DataFrame, grid: DataFrame, pane: int) -> DataFrame:
    """paired_counts() from (detector, __place, value, n), the counts of panes; bounds of the grid must be multiples of the pane."""
    at = lambda c: F.floor(F.col(c) / pane).alias(c)
    pairs = grid.select("k", F.col("b_end").alias("x_end"), *[at(c) for c in ("a_start", "a_end", "b_start", "b_end")])
    sides = {("a_start", "a_end"): ["o1"], ("b_start", "b_end"): ["o2"]}
    found = window_totals(counts, pairs, {"k": "long", "x_end": "long"}, sides, ["detector", "value"], ["n"])
    return found.select("detector", "k", "x_end", "value", "o1", "o2")
