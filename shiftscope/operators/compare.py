"""Two-sample comparisons over paired histograms (detector, k, x_end, value, o1, o2): one row for each pair.

A lower value means more different windows. NULL means that the test is undefined for the pair.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.functions.tails import chi2_tail, f_tail, ks_tail_equal
from shiftscope.session import ship, written

PAIR = ("detector", "k", "x_end")


def _expected(counts: DataFrame) -> DataFrame:
    pair = Window.partitionBy(*PAIR)
    totals = counts.withColumns({"t1": F.sum("o1").over(pair), "t2": F.sum("o2").over(pair), "c": F.count(F.lit(1)).over(pair)})
    both = F.col("o1") + F.col("o2")
    return totals.withColumns({"e1": both * F.col("t1") / (F.col("t1") + F.col("t2")), "e2": both * F.col("t2") / (F.col("t1") + F.col("t2"))})


def _contingency(counts: DataFrame, term, min_expected: float) -> DataFrame:
    """Statistic, degrees of freedom and p-value; with one degree of freedom observations move half a count towards expectation."""
    towards = lambda o, e: F.col(o) + F.signum(F.col(e) - F.col(o)) * F.least(F.lit(0.5), F.abs(F.col(e) - F.col(o)))
    adjusted = _expected(counts).withColumns(
        {"a1": F.when(F.col("c") == 2, towards("o1", "e1")).otherwise(F.col("o1").cast("double")), "a2": F.when(F.col("c") == 2, towards("o2", "e2")).otherwise(F.col("o2").cast("double"))}
    )
    scored = adjusted.groupBy(*PAIR).agg(
        F.sum(term(F.col("a1"), F.col("e1")) + term(F.col("a2"), F.col("e2"))).alias("statistic"),
        (F.first("c") - 1).alias("dof"),
        F.min(F.least("e1", "e2")).alias("least"),
        F.min(F.least("t1", "t2")).alias("side"),
    )
    defined = (F.col("least") >= min_expected) & (F.col("side") > 0)
    statistic = F.when(F.col("dof") == 0, 0.0).otherwise(F.col("statistic"))
    kept = scored.select(*PAIR, F.when(defined, statistic).alias("statistic"), F.col("dof").cast("long").alias("dof"))
    return kept.withColumn("value", F.when(F.col("statistic").isNotNull(), chi2_tail(F.col("statistic"), F.col("dof"))))


def g_test(counts: DataFrame, min_expected: float = 5) -> DataFrame:
    """(detector, k, x_end, statistic, dof, value): likelihood ratio."""
    return _contingency(counts, lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0), min_expected)


def chi_squared(counts: DataFrame, min_expected: float = 5) -> DataFrame:
    """(detector, k, x_end, statistic, dof, value): Pearson."""
    return _contingency(counts, lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0), min_expected)


def hellinger(counts: DataFrame) -> DataFrame:
    """(detector, k, x_end, value): one less the Hellinger distance of the shares."""
    pair = Window.partitionBy(*PAIR)
    shares = counts.withColumns({"p": F.col("o1") / F.sum("o1").over(pair), "q": F.col("o2") / F.sum("o2").over(pair)})
    gap = (F.sqrt("p") - F.sqrt("q")) * (F.sqrt("p") - F.sqrt("q"))
    return shares.groupBy(*PAIR).agg((1 - F.sqrt(F.sum(gap)) / F.sqrt(F.lit(2.0))).alias("value"))


#: Up to this many values a side the p-value of unequal sides is exact, as in the statistics library that users of
#: two-sample tests know; beyond it that library takes the limiting distribution. ks_test(exact=None) never does.
KS_EXACT = 10_000


def ks_p_unequal(d: float, n1: int, n2: int, exact: int | None = KS_EXACT) -> float:
    """Exact by counting lattice paths that stay within the distance, in a band around the diagonal; the limiting series beyond `exact` values."""
    if exact is not None and max(n1, n2) > exact:
        x = d * np.sqrt(n1 * n2 / (n1 + n2))
        k = np.arange(1, 101)
        return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)), 0, 1)) if x > 0.05 else 1.0
    h = round(d * n1 * n2)
    if h == 0:
        return 1.0
    n1, n2 = max(n1, n2), min(n1, n2)
    # only places within the distance have paths: about d * n2 of a column on either side of the diagonal
    columns = np.arange(n1 + 1)
    lows = np.maximum(0, (columns * n2 - h) // n1 + 1)
    highs = np.minimum(n2, -((-columns * n2 - h) // n1) - 1)
    # numbers of paths, carried as weights so that they stay in range
    chance, log_scale = np.ones(highs[0] + 1), 0.0
    for i in range(1, n1 + 1):
        low, high, before = lows[i], highs[i], lows[i - 1]
        if high < low:
            return 1.0
        # a place is reached from the column before and from below
        from_left = np.zeros(high - low + 1)
        known = chance[low - before :][: len(from_left)]
        from_left[: len(known)] = known
        chance = np.cumsum(from_left)
        top = chance[-1]
        if top <= 0:
            return 1.0
        chance /= top
        log_scale += np.log(top)
    k = np.arange(1, n1 + 1)
    log_paths = np.log((n2 + k) / k).sum()
    last = chance[n2 - lows[n1]] if lows[n1] <= n2 <= highs[n1] else 0.0
    return float(np.clip(1 - np.exp(np.log(max(last, 1e-300)) + log_scale - log_paths), 0, 1))


def _ks_unequal(exact: int | None):
    @F.pandas_udf(T.DoubleType())
    def tail(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or a == b else ks_p_unequal(x, int(a), int(b), exact) for x, a, b in zip(d, n1, n2, strict=True)], dtype=float)

    return tail


def ks_test(counts: DataFrame, exact: int | None = KS_EXACT) -> DataFrame:
    """(detector, k, x_end, statistic, value): Kolmogorov-Smirnov on numeric values, NULLs dropped; NULL for an empty side.

    counts may be a histogram or one row for each value. One exchange by pair serves the running sums and their maximum.
    """
    ship(counts.sparkSession)
    number = F.col("value").cast("double")
    known = F.when(number.isNotNull(), 1).otherwise(0)
    kept = counts.select(*PAIR, number.alias("value"), (F.col("o1") * known).alias("o1"), (F.col("o2") * known).alias("o2"))
    upto = Window.partitionBy(*PAIR).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*PAIR)
    steps = kept.withColumns({"t1": F.sum("o1").over(whole), "t2": F.sum("o2").over(whole), "c1": F.sum("o1").over(upto), "c2": F.sum("o2").over(upto)})
    d = F.max(F.abs(F.try_divide(F.col("c1"), F.col("t1")) - F.try_divide(F.col("c2"), F.col("t2"))))
    return _ks_valued(steps.groupBy(*PAIR).agg(d.alias("statistic"), F.first("t1").alias("n1"), F.first("t2").alias("n2")), exact)


def _ks_valued(scored: DataFrame, exact: int | None) -> DataFrame:
    equal = F.when((F.col("n1") == F.col("n2")) & F.col("statistic").isNotNull(), ks_tail_equal(F.col("statistic"), F.col("n1")))
    other = scored.withColumn("other", _ks_unequal(exact)("statistic", "n1", "n2"))
    return other.select(*PAIR, "statistic", F.coalesce(equal, F.col("other")).alias("value"))


#: Positions that one task compares windows in, at least; and the numbers that it sorts at a time.
KS_BLOCK = 1 << 13
KS_CELLS = 1 << 22


def _ks_block(key: tuple, values: pa.Table, pairs: pa.Table) -> pa.Table:
    """The distances of a block's pairs of windows, for each detector: ranks of its values, sorted by pair as rows of a matrix."""
    k, x_end, bounds = pairs.column("k").to_numpy(), pairs.column("x_end").to_numpy(), [pairs.column(c).to_numpy() for c in ("a_start", "a_end", "b_start", "b_end")]
    names, codes = np.unique(values.column("detector").to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if len(values) else (np.zeros(0, str), np.zeros(0, int))
    at, number = values.column("trace_idx").to_numpy(), values.column("value").to_numpy(zero_copy_only=False).astype(float)
    missing = values.column("value").is_null().to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, bool)
    out: list[tuple] = []
    for d, name in enumerate(names):
        own = np.flatnonzero(codes == d)
        own = own[np.argsort(at[own], kind="stable")]
        seen = at[own]
        rows = np.zeros(len(k), bool)
        for start, end in (bounds[:2], bounds[2:]):
            rows |= np.searchsorted(seen, end, side="right") > np.searchsorted(seen, start, side="left")
        own = own[~missing[own]]
        seen = at[own]
        _, rank = np.unique(number[own], return_inverse=True)
        beyond = int(rank.max()) + 1 if len(rank) else 0
        rank = np.append(rank, beyond)
        a0, a1, b0, b1 = (np.searchsorted(seen, x, side=s) for x, s in zip(bounds, ("left", "right", "left", "right"), strict=True))
        n1, n2 = a1 - a0, b1 - b0
        distance = np.full(len(k), np.nan)
        both = np.flatnonzero((n1 > 0) & (n2 > 0))
        step = max(1, KS_CELLS // max(1, int((n1 + n2)[both].max()) if len(both) else 1))
        for p in range(0, len(both), step):
            i = both[p : p + step]
            parts, sides = [], []
            for first, n in ((a0, n1), (b0, n2)):
                place = np.arange(int(n[i].max()))[None, :]
                inside = place < n[i][:, None]
                parts.append(np.where(inside, rank[np.where(inside, first[i][:, None] + place, len(rank) - 1)], beyond))
                sides.append(inside)
            ranks = np.concatenate(parts, axis=1)
            order = np.argsort(ranks, axis=1)
            zeros = [np.zeros_like(s) for s in sides]
            upto = [np.cumsum(np.take_along_axis(np.concatenate(x, axis=1), order, axis=1), axis=1) for x in ((sides[0], zeros[1]), (zeros[0], sides[1]))]
            sorted_ranks = np.take_along_axis(ranks, order, axis=1)
            last = np.ones_like(sorted_ranks, dtype=bool)
            last[:, :-1] = sorted_ranks[:, 1:] != sorted_ranks[:, :-1]
            distance[i] = np.where(last, np.abs(upto[0] / n1[i][:, None] - upto[1] / n2[i][:, None]), 0).max(axis=1)
        kept = np.flatnonzero(rows)
        out.append((np.full(len(kept), name, object), k[kept], x_end[kept], distance[kept], n1[kept], n2[kept]))
    whole = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, object), *[np.zeros(0)] * 5]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    arrays = [pa.array(c.astype(t.to_pandas_dtype()) if t != pa.string() else c, t, from_pandas=True) for c, t in zip(whole, kinds, strict=True)]
    return pa.Table.from_arrays(arrays, ["detector", "k", "x_end", "statistic", "n1", "n2"])


def ks_series(values: DataFrame, grid: DataFrame, exact: int | None = KS_EXACT) -> DataFrame:
    """ks_test() of (detector, trace_idx, value) over a grid: (detector, k, x_end, statistic, value).

    Positions are dealt to blocks a few times as long as the longest pair of windows. A pair is compared where it begins, so a trace
    goes to its block and the one before: what is shuffled is the table once, and a part of it twice. Blocks without pairs
    are left out before. A task holds the traces of one block.
    """
    ship(values.sparkSession)
    start, end = F.least("a_start", "b_start"), F.greatest("a_end", "b_end")
    span = grid.agg(F.max(end - start + 1)).first()[0] or 1
    width = max(KS_BLOCK, 4 * span)
    pairs = grid.select(F.floor(start / width).alias("block"), F.col("k").cast("long"), F.col("b_end").cast("long").alias("x_end"), *[F.col(c).cast("long") for c in ("a_start", "a_end", "b_start", "b_end")])
    blocks = written(pairs.select("block").distinct(), "ks-blocks")
    if blocks.count() <= 1_000_000:
        blocks = F.broadcast(blocks)
    at = F.col("trace_idx")
    dealt = values.select("detector", at.cast("long"), F.col("value").cast("double"), F.explode(F.sequence(F.floor((at - (span - 1)) / width), F.floor(at / width))).alias("block"))
    met = dealt.join(blocks, "block", "left_semi").groupBy("block").cogroup(pairs.groupBy("block"))
    scored = met.applyInArrow(_ks_block, "detector string, k long, x_end long, statistic double, n1 long, n2 long")
    return _ks_valued(scored, exact)


def hotelling(samples: DataFrame, columns: list[str]) -> DataFrame:
    """(detector, k, x_end, statistic, value) from rows (detector, k, x_end, side 1 or 2, columns): Hotelling's T squared.

    Means and products are aggregated per pair and side; what is solved is one small matrix for each pair. A singular
    pooled covariance gives 1.
    """
    p = len(columns)
    vector = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    products = [F.covar_samp(columns[i], columns[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    return _hotelling_solved(samples.groupBy(*PAIR, "side").agg(F.count(F.lit(1)).alias("n"), *vector, *products), p)


def hotelling_panes(rows: DataFrame, grid: DataFrame, columns: list[str], pane: int) -> DataFrame:
    """hotelling() over rows (detector, trace_idx, columns) and a grid whose windows begin and end at multiples of pane.

    Counts, sums and products are taken once per pane, around the means of all rows, and added up over the panes of
    each window.
    """
    p = len(columns)
    centre = F.broadcast(rows.agg(*[F.avg(c).alias(f"__c{i}") for i, c in enumerate(columns)]))
    at = F.floor(F.col("trace_idx") / pane).alias("pane")
    moved = rows.crossJoin(centre).select("detector", at, *[(F.col(c) - F.col(f"__c{i}")).alias(f"x{i}") for i, c in enumerate(columns)])
    sums = [F.count(F.lit(1)).alias("n")]
    for i in range(p):
        sums += [F.count(f"x{i}").alias(f"k{i}"), F.sum(f"x{i}").alias(f"t{i}")]
        for j in range(i, p):
            product = F.col(f"x{i}") * F.col(f"x{j}")
            both = lambda c, product=product: F.sum(F.when(product.isNotNull(), F.col(c)))
            sums += [F.count(product).alias(f"k{i}_{j}"), both(f"x{i}").alias(f"a{i}_{j}"), both(f"x{j}").alias(f"b{i}_{j}"), F.sum(product).alias(f"p{i}_{j}")]
    panes = moved.groupBy("detector", "pane").agg(*sums)
    sides = None
    for side, start, end in ((1, "a_start", "a_end"), (2, "b_start", "b_end")):
        held = F.explode(F.sequence(F.floor(F.col(start) / pane), F.floor(F.col(end) / pane))).alias("pane")
        own = grid.select("k", F.col("b_end").alias("x_end"), F.lit(side).alias("side"), held)
        sides = own if sides is None else sides.unionAll(own)
    added = panes.join(sides, "pane").groupBy(*PAIR, "side").agg(*[F.sum(c).alias(c) for c in panes.columns if c not in ("detector", "pane")])
    vector = [F.try_divide(F.col(f"t{i}"), F.col(f"k{i}")).alias(f"m{i}") for i in range(p)]
    products = []
    for i in range(p):
        for j in range(i, p):
            k, a, b, of = (F.col(f"{c}{i}_{j}") for c in "kabp")
            products.append(F.when(k > 1, (of - a * b / k) / (k - 1)).alias(f"s{i}_{j}"))
    return _hotelling_solved(added.select(*PAIR, "side", "n", *vector, *products), p)


def _hotelling_solved(sides: DataFrame, p: int) -> DataFrame:
    first, second = (sides.filter(F.col("side") == k).drop("side") for k in (1, 2))
    renamed = second.withColumnsRenamed({c: f"{c}_2" for c in second.columns if c not in PAIR})
    both = first.join(renamed, list(PAIR))

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                n1, n2 = r.n, r.n_2
                diff = np.array([getattr(r, f"m{i}") - getattr(r, f"m{i}_2") for i in range(p)])
                pooled = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        pooled[i, j] = pooled[j, i] = ((n1 - 1) * getattr(r, f"s{i}_{j}") + (n2 - 1) * getattr(r, f"s{i}_{j}_2")) / (n1 + n2 - 2) if min(n1, n2) > 1 else np.nan
                if np.isnan(pooled).any() or n1 + n2 - p - 1 <= 0:
                    out.append(None)
                elif np.linalg.matrix_rank(pooled) < p:
                    out.append(0.0)
                else:
                    out.append(float(n1 * n2 / (n1 + n2) * diff @ np.linalg.solve(pooled, diff)) * (n1 + n2 - p - 1) / (p * (n1 + n2 - 2)))
            yield pd.DataFrame({**{c: rows[c] for c in PAIR}, "n": rows.n + rows.n_2, "statistic": pd.Series(out, dtype=float)})

    kind = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    solved = both.mapInPandas(solve, ", ".join(f"{c} {kind[c]}" for c in PAIR) + ", n long, statistic double").withColumn("statistic", F.nanvl("statistic", F.lit(None).cast("double")))
    tail = f_tail(F.greatest("statistic", F.lit(0.0)), F.lit(float(p)), (F.col("n") - p - 1).cast("double"))
    return solved.select(*PAIR, "statistic", F.when(F.col("statistic").isNotNull(), tail).alias("value"))


def user_comparer(counts: DataFrame, score: Column) -> DataFrame:
    """A comparison of the caller's: score is an aggregate over o1 and o2."""
    return counts.groupBy(*PAIR).agg(score.alias("value"))
