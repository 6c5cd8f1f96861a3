"""Control-flow features of events (scope..., trace_idx, event_idx, activity).

scope is a list of key columns: none for a whole log, window keys for features by window. All results carry them.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.operators.blocks import PARTITION_WINDOWS, window_totals
from shiftscope.session import written


def sequences(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, trace_idx, activities): each trace's activities in order."""
    keys = [*(scope or []), "trace_idx"]
    gathered = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("event_idx", "activity"))).alias("__e"))
    return gathered.select(*keys, F.col("__e.activity").alias("activities"))


def activity_counts(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return events.groupBy(*(scope or []), "activity").agg(F.count(F.lit(1)).alias("n"))


def counted(events: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What all relations of a scope are made of, as sums over its traces, so that the counts of panes add up to those of windows.

    pairs: (scope, a1, a2, n), the pairs of events of a trace in which a2 comes anywhere after a1. acts: (scope, activity, occurs,
    early, every), its events, those before the last one of their trace, and those in traces of two events or more. Each
    event meets the activities of its trace, not its events: a running count of each replaces the pairs.
    """
    scope = scope or []
    trace = [*scope, "trace_idx"]
    whole = Window.partitionBy(*trace)
    placed = events.select(*trace, "event_idx", "activity").withColumns({"__last": F.max("event_idx").over(whole), "__n": F.count(F.lit(1)).over(whole)})
    longer = placed.filter("__n > 1")
    own = longer.select(*trace, F.col("activity").alias("a1")).distinct()
    before = Window.partitionBy(*trace, "a1").orderBy("event_idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = longer.join(own, trace).withColumn("n", F.sum((F.col("activity") == F.col("a1")).cast("long")).over(before))
    pairs = seen.groupBy(*scope, "a1", F.col("activity").alias("a2")).agg(F.sum("n").alias("n"))
    several = F.col("__n") > 1
    acts = placed.groupBy(*scope, "activity").agg(
        F.count(F.lit(1)).alias("occurs"), F.count_if(several & (F.col("event_idx") < F.col("__last"))).alias("early"), F.count_if(several).alias("every")
    )
    return pairs, acts


def _sorted(table: DataFrame, scope: list[str]) -> DataFrame:
    """A side of a join by scope. Sums of windows are read from few bytes, by which plans would take them for small and send them whole to the driver and all tasks."""
    return table.hint("merge") if scope else table


def _cells(pairs: DataFrame, acts: DataFrame, direction: str, scope: list[str]) -> DataFrame:
    early = acts.filter("early > 0").select(*scope, F.col("activity").alias("a1"))
    every = acts.filter("every > 0").select(*scope, F.col("activity").alias("a2"))
    domain = early.join(_sorted(every, scope), scope) if scope else early.crossJoin(every)
    cells = domain.join(_sorted(pairs, scope), [*scope, "a1", "a2"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    if direction == "followed_by":
        return cells
    return cells.select(*scope, F.col("a2").alias("a1"), F.col("a1").alias("a2"), "n")


def _relations(pairs: DataFrame, acts: DataFrame, direction: str, scope: list[str]) -> DataFrame:
    occurs = acts.select(*scope, F.col("activity").alias("a2"), F.col("occurs").alias("__occurs"))
    cells = _cells(pairs, acts, direction, scope).join(_sorted(occurs, scope), [*scope, "a2"])
    return cells.select(*scope, "a1", "a2", "n", F.when(F.col("n") == F.col("__occurs"), "a").when(F.col("n") > 0, "s").otherwise("n").alias("relation"))


def _relation_counts(pairs: DataFrame, acts: DataFrame, direction: str, scope: list[str], parts: int = 0) -> DataFrame:
    """The relations of _relations(), counted; a scope's are dealt to parts, if given.

    Pairs and activities of a scope lie together, so nothing is joined; cells without a pair are counted and not made.
    """
    (x, row), (y, column) = (("a1", "early"), ("a2", "every"))[:: 1 if direction == "followed_by" else -1]
    none = F.lit(None).cast("long")
    known = F.col("activity").isNotNull()
    cells = pairs.filter("n > 0 AND a1 IS NOT NULL AND a2 IS NOT NULL").select(*scope, F.col(x).alias("activity"), F.col(y).alias("__of"), "n", none.alias("__occurs"), none.alias("__row"))
    # an activity is met by the cells of its column, and stands for itself in its row
    own = acts.select(*scope, "activity", F.col("activity").alias("__of"), none.alias("n"), F.when(known & (F.col(column) > 0), F.col("occurs")).alias("__occurs"), F.col(row).alias("__row"))
    both = cells.unionAll(own)
    # dealt once, after the union: all that follows is by scope
    both = both.repartition(parts, *scope) if parts else both
    met = both.withColumn("__occurs", F.max("__occurs").over(Window.partitionBy(*scope, "__of")))
    rows = met.groupBy(*scope, "activity").agg(
        F.count_if(F.col("n") == F.col("__occurs")).alias("always"),
        F.count_if(F.col("n") != F.col("__occurs")).alias("sometimes"),
        F.count_if(F.col("n").isNull() & F.col("__occurs").isNotNull()).alias("__column"),
        F.max("__row").alias("__row"),
    )
    rows = rows.withColumn("__columns", F.sum("__column").over(Window.partitionBy(*scope))).filter("__row > 0")
    return rows.select(*scope, "activity", "always", "sometimes", (F.col("__columns") - F.col("always") - F.col("sometimes")).alias("never"))


def _bidirectional(pairs: DataFrame, acts: DataFrame, scope: list[str], parts: int = 0) -> DataFrame:
    sides = []
    for direction in ("followed_by", "preceded_by"):
        own = _relation_counts(pairs, acts, direction, scope, parts)
        sides.append(own.withColumnsRenamed({c: f"{direction}_{c}" for c in ("always", "sometimes", "never")}))
    return sides[0].join(sides[1], [*scope, "activity"], "full_outer")


def _entropy(pairs: DataFrame, acts: DataFrame, direction: str, scope: list[str], parts: int = 0) -> DataFrame:
    rows = _relation_counts(pairs, acts, direction, scope, parts).withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(*scope)))
    part = lambda c: F.when(F.col(c) > 0, -(F.col(c) / F.col("__rows")) * F.log2(F.col(c) / F.col("__rows"))).otherwise(0.0)
    return rows.select(*scope, "activity", (part("always") + part("sometimes") + part("never")).alias("entropy"))


def causality_counts(events: DataFrame, direction: str = "followed_by", scope: list[str] | None = None) -> DataFrame:
    """(scope, a1, a2, n): pairs of events in which a2 comes anywhere after a1 (followed_by) or before it (preceded_by).

    Cells without a pair are 0. Rows are the activities that stand before (after) another one, columns all
    activities of traces of two events or more.
    """
    return _cells(*counted(events, scope), direction, scope or [])


def relations(events: DataFrame, direction: str = "followed_by", scope: list[str] | None = None) -> DataFrame:
    """(scope, a1, a2, n, relation): a if the count is a2's number of occurrences, s if it is another positive one, else n."""
    return _relations(*counted(events, scope), direction, scope or [])


def relation_counts(events: DataFrame, direction: str = "followed_by", scope: list[str] | None = None) -> DataFrame:
    """(scope, activity, always, sometimes, never)"""
    return _relation_counts(*counted(events, scope), direction, scope or [])


def bidirectional_counts(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """relation_counts of both directions side by side; NULL where an activity has none."""
    return _bidirectional(*counted(events, scope), scope or [])


def relational_entropy(events: DataFrame, direction: str = "followed_by", scope: list[str] | None = None) -> DataFrame:
    """(scope, activity, entropy) of the three counts over the number of activities with a row."""
    return _entropy(*counted(events, scope), direction, scope or [])


def directly_follows(events: DataFrame, scope: list[str] | None = None, direction: str = "followed_by", by_trace: bool = False) -> DataFrame:
    """(scope, a1, a2): distinct neighbours, of the scope or of each trace."""
    scope = scope or []
    order = Window.partitionBy(*scope, "trace_idx").orderBy("event_idx")
    pairs = events.withColumn("a2", F.lead("activity").over(order)).filter("a2 IS NOT NULL").withColumnRenamed("activity", "a1")
    if direction != "followed_by":
        pairs = pairs.withColumnsRenamed({"a1": "a2", "a2": "a1"})
    return pairs.select(*scope, *(["trace_idx"] if by_trace else []), "a1", "a2").distinct()


def concurrency(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, a1, a2): neighbours in both orders, an activity with itself included."""
    follows = directly_follows(events, scope)
    return follows.intersect(follows.select(*(scope or []), F.col("a2").alias("a1"), F.col("a1").alias("a2")))


def runs(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, trace_idx, run): the trace's partial-order edges in order, as text; empty for traces of one event.

    An edge (x, y) between neighbours gives itself, (c, y) for the activities c concurrent to x, (x, c) for those
    concurrent to y, and (y, x) if both are concurrent. Concurrency is that of the scope.
    """
    scope = scope or []
    trace = [*scope, "trace_idx"]
    edges = directly_follows(events, scope, by_trace=True).filter("a1 != a2")
    beside = concurrency(events, scope).select(*scope, F.col("a1").alias("__of"), F.col("a2").alias("__c"))
    keys = lambda c: [edges[s] == beside[s] for s in scope] + [edges[c] == beside["__of"]]
    of_first = edges.join(beside, keys("a1")).select(*[edges[c] for c in trace], F.when(F.col("__c") == F.col("a2"), F.struct(F.col("a2").alias("x"), F.col("a1").alias("y"))).otherwise(F.struct(F.col("__c").alias("x"), F.col("a2").alias("y"))).alias("e"))
    of_second = edges.join(beside, keys("a2")).filter("__c != a1").select(*[edges[c] for c in trace], F.struct(F.col("a1").alias("x"), F.col("__c").alias("y")).alias("e"))
    plain = edges.select(*trace, F.struct(F.col("a1").alias("x"), F.col("a2").alias("y")).alias("e"))
    gathered = plain.unionAll(of_first).unionAll(of_second).groupBy(*trace).agg(F.sort_array(F.collect_set("e")).alias("__edges"))
    text = F.array_join(F.transform("__edges", lambda e: F.concat(e["x"], F.lit(">"), e["y"])), ";")
    return events.select(*trace).distinct().join(gathered.select(*trace, text.alias("run")), trace, "left").withColumn("run", F.coalesce("run", F.lit("")))


def window_sums(panes: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over windows (w_start, w_end, keys, sums) of the counts of panes (pane, keys, counts); windows are window_panes()."""
    counts = [c for c in panes.columns if c not in ("pane", *keys)]
    scope = {"w_start": "long", "w_end": "long"}
    return window_totals(panes.withColumnRenamed("pane", "__place"), windows, scope, {("__low", "__high"): counts}, keys, counts)


def window_panes(grid: DataFrame, pane: int) -> DataFrame:
    """(w_start, w_end, __low, __high): the first and last pane of each distinct window; bounds are multiples of pane."""
    from shiftscope.operators.grid import ranges

    return ranges(grid).withColumns({"__low": F.floor(F.col("w_start") / pane), "__high": F.floor(F.col("w_end") / pane)})


def run_of(edges: Column, beside: Column) -> Column:
    """The run, as runs() has it, of a trace's distinct neighbours (array of a1, a2), given the concurrent pairs."""
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def more(e: Column) -> Column:
        of_first = F.transform(F.filter(beside, lambda p: p["a1"] == e["a1"]), lambda p: F.when(p["a2"] == e["a2"], pair(e["a2"], e["a1"])).otherwise(pair(p["a2"], e["a2"])))
        of_second = F.transform(F.filter(beside, lambda p: (p["a1"] == e["a2"]) & (p["a2"] != e["a1"])), lambda p: pair(e["a1"], p["a2"]))
        return F.concat(F.array(pair(e["a1"], e["a2"])), of_first, of_second)

    every = F.flatten(F.transform(F.filter(edges, lambda e: e["a1"] != e["a2"]), more))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(every)), lambda e: F.concat(e["x"], F.lit(">"), e["y"])), ";")


def _numbered(texts: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct texts of a column with a number each, written, so that wide joins carry numbers only."""
    return written(texts.select(column).distinct().withColumn(name, F.monotonically_increasing_id()), f"numbered-{name}")


def runs_series_counts(events: DataFrame, grid: DataFrame, pane: int = 1, texts: bool = True) -> DataFrame:
    """Paired histogram of the runs of each pair of windows, concurrency taken in each window; bounds are multiples of pane.

    A trace's neighbours do not depend on the window, so traces of the same ones are one kind, counted by pane and added up
    by window. So are the neighbours of a pane's traces, from which a window's concurrency follows. A run is made once for each
    kind of trace and each concurrency that they meet. Kinds, concurrencies and runs are numbers in all joins by window;
    value is a run's text, or without texts its number, which is enough to compare windows.
    """
    order = Window.partitionBy("trace_idx").orderBy("event_idx")
    near = events.withColumn("a2", F.lead("activity").over(order))
    edge = F.when(F.col("a2").isNotNull(), F.struct(F.col("activity").alias("a1"), "a2"))
    # sets of pairs are compared as text, which happens once a trace and once a window
    pairs = "array<struct<a1:string,a2:string>>"
    traces = written(near.groupBy("trace_idx").agg(F.to_json(F.array_sort(F.collect_set(edge))).alias("kind_text")), "run-traces")
    kinds = _numbered(traces, "kind_text", "kind")
    placed = traces.select(F.floor(F.col("trace_idx") / pane).alias("pane"), "kind_text").join(kinds, "kind_text")
    panes = written(placed.groupBy("pane", "kind").agg(F.count(F.lit(1)).alias("n")), "run-panes")
    windows, scope = window_panes(grid, pane), ["w_start", "w_end"]
    held = window_sums(panes, windows, ["kind"])

    edges = kinds.select("kind", F.explode(F.from_json("kind_text", pairs)).alias("edge"))
    pane_edges = panes.select("pane", "kind").join(edges, "kind").select("pane", "edge.*", F.lit(1).alias("traces"))
    found = window_sums(pane_edges, windows, ["a1", "a2"]).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("a1", "a2"))).alias("every"))
    both_ways = F.filter("every", lambda e: F.array_contains("every", F.struct(e["a2"].alias("a1"), e["a1"].alias("a2"))))
    concurrent = written(found.select(*scope, F.to_json(both_ways).alias("beside_text")), "run-concurrency")
    besides = _numbered(concurrent, "beside_text", "beside")
    known = held.join(concurrent.join(besides, "beside_text").select(*scope, "beside"), scope, "left").withColumn("beside", F.coalesce("beside", F.lit(-1)))

    met = known.select("kind", "beside").distinct().join(kinds, "kind").join(besides, "beside", "left")
    text = run_of(F.from_json("kind_text", pairs), F.from_json(F.coalesce("beside_text", F.lit("[]")), pairs))
    made = written(met.select("kind", "beside", text.alias("run")), "runs-made")
    runs = _numbered(made, "run", "value")
    runs_of = made.join(runs, "run").select("kind", "beside", "value")
    by_window = known.join(runs_of, ["kind", "beside"]).groupBy(*scope, "value").agg(F.sum("n").alias("n"))
    first = grid.select("k", F.col("b_end").alias("x_end"), F.col("a_start").alias("w_start"), F.col("a_end").alias("w_end"), F.lit(1).alias("side"))
    sides = first.unionAll(grid.select("k", "b_end", "b_start", "b_end", F.lit(2)))
    count = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    counts = by_window.join(sides, scope).groupBy(F.lit("Runs").alias("detector"), "k", "x_end", "value").agg(count(1).alias("o1"), count(2).alias("o2"))
    if not texts:
        return counts
    return counts.join(runs, "value").select("detector", "k", "x_end", F.col("run").alias("value"), "o1", "o2")


def feature_samples(events: DataFrame, grid: DataFrame, feature: str, direction: str = "followed_by", pane: int = 1) -> tuple[DataFrame, list[str]]:
    """(detector, k, x_end, side, columns) of a feature of both windows of each pair, a row for each activity, and the columns.

    `Relational Entropy` has one column, `Relation Type Counts` the six of both directions, NaN where an activity has none.
    Events are counted once, by pane (bounds are multiples of pane); windows add up the counts of their panes, of which there
    is one for each pair of activities at most.
    """
    scope = ["w_start", "w_end"]
    if feature not in ("Relational Entropy", "Relation Type Counts"):
        raise ValueError(f"unknown feature {feature}")
    windows = window_panes(grid, pane)
    # adaptive plans would merge both traces and windows, which have few compressed bytes, into as few tasks as the session has cores
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(windows.count() / PARTITION_WINDOWS))
    pairs, acts = counted(events.withColumn("pane", F.floor(F.col("trace_idx") / pane)).repartition(parts, "pane", "trace_idx"), ["pane"])
    summed = written(window_sums(pairs, windows, ["a1", "a2"]), "window-pairs"), written(window_sums(acts, windows, ["activity"]), "window-acts")
    if feature == "Relational Entropy":
        rows, columns = _entropy(*summed, direction, scope, parts), ["entropy"]
    else:
        rows = _bidirectional(*summed, scope, parts)
        columns = [c for c in rows.columns if c not in (*scope, "activity")]
    sides = [grid.select("k", F.col("b_end").alias("x_end"), F.col(f"{s}_start").alias("w_start"), F.col(f"{s}_end").alias("w_end"), F.lit(i).alias("side")) for i, s in ((1, "a"), (2, "b"))]
    met = _sorted(rows, scope).join(reduce(DataFrame.unionAll, sides), scope)
    return met.select(F.lit(feature).alias("detector"), "k", "x_end", "side", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]), columns


def feature_series(events: DataFrame, grid: DataFrame, feature: str, min_samples: float = 5, pane: int = 1) -> DataFrame:
    """(detector, k, x_end, statistic, value): G-tests of `Runs`, Hotelling's test of the other features."""
    from shiftscope.operators.compare import g_test, hotelling

    if feature == "Runs":
        return g_test(runs_series_counts(events, grid, pane, texts=False), min_samples).drop("dof")
    return hotelling(*feature_samples(events, grid, feature, pane=pane))
