"""Exploratory summaries of traces and attributes."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _halo(rows: DataFrame, size: int, order: str) -> tuple[DataFrame, Window]:
    """rows with a block, each block having the size - 1 rows before it as well, and the sliding frame within blocks.

    A sliding window over a whole log needs neighbours only, so it is spread over blocks of positions.
    """
    block = max(size, 8192)
    own = F.floor(F.col(order) / block)
    here = rows.withColumn("__block", own).withColumn("__halo", F.lit(False))
    next_ = rows.filter(F.col(order) % block > block - size).withColumn("__block", own + 1).withColumn("__halo", F.lit(True))
    return here.unionAll(next_), Window.partitionBy("__block").orderBy(order).rowsBetween(-(size - 1), 0)


def value_distribution(values: DataFrame, size: int = 200) -> DataFrame:
    """(detector, key, value, share): shares of each value among the non-null ones of the size traces before key.

    values is (detector, trace_idx, value) with one row per trace; keys run from size on, and the window that
    ends the log has none. Values that are absent from a window have no row.
    """
    block = max(size, 8192)
    last = values.agg(F.max("trace_idx").alias("last"))
    own = F.floor(F.col("trace_idx") / block)
    known = values.filter("value IS NOT NULL")
    spread = known.withColumn("__block", F.explode(F.when(F.col("trace_idx") % block > block - size - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    # a trace enters the windows with keys trace_idx + 1 to trace_idx + size
    steps = spread.select("detector", "__block", "value", F.explode(F.array(F.struct(F.greatest(F.col("trace_idx") + 1, F.col("__block") * block).alias("key"), F.lit(1).alias("d")), F.struct((F.col("trace_idx") + size + 1).alias("key"), F.lit(-1).alias("d")))).alias("s"))
    keys = values.select("detector", F.col("trace_idx").alias("key")).distinct().crossJoin(F.broadcast(last)).filter((F.col("key") >= size) & (F.col("key") <= F.col("last"))).drop("last").withColumn("__block", F.floor(F.col("key") / block))
    grid = keys.join(spread.select("detector", "__block", "value").distinct(), ["detector", "__block"]).select("detector", "__block", "value", "key", F.lit(0).alias("d"), F.lit(1).alias("ask"))
    events = steps.select("detector", "__block", "value", "s.key", "s.d", F.lit(0).alias("ask")).unionAll(grid)
    upto = Window.partitionBy("detector", "__block", "value").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("n", F.sum("d").over(upto)).filter("ask = 1 AND n > 0")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("detector", "key"))
    return counted.select("detector", "key", "value", share.alias("share"))


def rolling_mean(rows: DataFrame, column: str, size: int = 200, order: str = "trace_idx") -> DataFrame:
    """rows with rolling_mean of the last size values, missing ones taken as the mean of all; NULL before size rows."""
    mean = rows.agg(F.avg(column).alias("__mean"))
    filled = rows.crossJoin(F.broadcast(mean)).withColumn("__v", F.coalesce(F.col(column).cast("double"), "__mean")).drop("__mean")
    spread, frame = _halo(filled, size, order)
    full = F.count(F.lit(1)).over(frame) == size
    rolled = spread.withColumn("rolling_mean", F.when(full, F.avg("__v").over(frame)))
    return rolled.filter(~F.col("__halo")).drop("__block", "__halo", "__v")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def before_after(rows: DataFrame, column: str, change_point: int, width: int = 200, missing: str = "None") -> DataFrame:
    """(value, before, after, before_share, after_share) of the width traces up to a change point and after it."""
    near = rows.filter(F.col("trace_idx").between(change_point - width + 1, change_point + width))
    side = F.col("trace_idx") <= change_point
    counted = near.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count_if(side).alias("before"), F.count_if(~side).alias("after"))
    everything = Window.partitionBy()
    return counted.withColumns({"before_share": F.col("before") / F.sum("before").over(everything), "after_share": F.col("after") / F.sum("after").over(everything)})


def describe(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles, maximum."""
    c = F.col(column)
    quartiles = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), quartiles.alias("__q"), F.max(c).alias("max"))
    return out.select(*by, "count", "mean", "std", "min", F.col("__q")[0].alias("q25"), F.col("__q")[1].alias("q50"), F.col("__q")[2].alias("q75"), "max")


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(c1, c2, corr) of all ordered pairs of different columns, rows with both present; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("c1"), F.lit(y).alias("c2"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def correlated_columns(corr: DataFrame, threshold: float) -> DataFrame:
    """(column, correlated): the columns whose correlation is above the threshold either way, comma-joined."""
    strong = corr.filter(F.abs("corr") > threshold)
    return strong.groupBy(F.col("c1").alias("column")).agg(F.array_join(F.sort_array(F.collect_list("c2")), ",").alias("correlated"))


def map_keys(frame: DataFrame, maps: list[str]) -> DataFrame:
    """(log_id, name) of the attributes that the maps of canonical traces or events hold."""
    keys = F.concat(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps])
    return frame.select("log_id", F.explode(keys).alias("name")).distinct()


def trace_attributes(traces: DataFrame) -> DataFrame:
    return map_keys(traces, ["tattrs_str", "tattrs_num"])


def event_attributes(events: DataFrame) -> DataFrame:
    """As trace_attributes(), without what a trace's attributes are called where they are written into events."""
    return map_keys(events, ["eattrs_str", "eattrs_num"]).filter(~F.startswith("name", F.lit("case:")))


def log_stats(traces: DataFrame, events: DataFrame) -> DataFrame:
    """(log_id, traces, events, trace_attributes, event_attributes) of canonical frames of one log or many."""
    count = lambda frame, name: frame.groupBy("log_id").agg(F.count(F.lit(1)).alias(name))
    parts = [count(traces, "traces"), count(events, "events"), count(trace_attributes(traces), "trace_attributes"), count(event_attributes(events), "event_attributes")]
    joined = reduce(lambda a, b: a.join(b, "log_id", "full_outer"), parts)
    return joined.na.fill(0, ["traces", "events", "trace_attributes", "event_attributes"])


def attribute_catalog(traces: DataFrame, events: DataFrame, trace_names: list[str] | None = None, event_names: list[str] | None = None) -> DataFrame:
    """(level, name, kind) of the attributes of canonical frames, those of the given names if there are any.

    Text is categorical, numbers are continuous. An attribute that is both raises an error. `place` orders the attributes
    by first sight: traces before events, then by trace, event and name.
    """
    found = []
    for level, frame, prefix, wanted, at in (("trace", traces, "tattrs", trace_names, F.struct("trace_idx", F.lit(0).alias("event_idx"))), ("event", events, "eattrs", event_names, F.struct("trace_idx", F.col("event_idx").cast("int").alias("event_idx")))):
        for suffix, kind in (("str", "categorical"), ("num", "continuous")):
            rows = frame.select(F.lit(level).alias("level"), F.explode(F.map_keys(f"{prefix}_{suffix}")).alias("name"), F.lit(kind).alias("kind"), at.alias("at"))
            rows = rows.filter(~F.startswith("name", F.lit("case:"))) if level == "event" else rows
            found.append(rows.filter(F.col("name").isin(wanted)) if wanted is not None else rows)
    every = reduce(DataFrame.unionAll, found)
    named = every.groupBy("level", "name").agg(F.collect_set("kind").alias("kinds"), F.min("at").alias("at"))
    mixed = F.raise_error(F.concat(F.lit("attribute of mixed kinds: "), "name")).cast("string")
    place = F.row_number().over(Window.orderBy(F.desc("level"), "at", "name")) - 1
    return named.select("level", "name", F.when(F.size("kinds") > 1, mixed).otherwise(F.col("kinds")[0]).alias("kind"), place.alias("place"))


def kind_of(data_type: T.DataType) -> str:
    """Numbers, booleans among them, are continuous; everything else is categorical."""
    return "continuous" if isinstance(data_type, T.NumericType | T.BooleanType) else "categorical"


def numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if kind_of(f.dataType) == "continuous"]


def attribute_presence(names: DataFrame, logs: list[str]) -> DataFrame:
    """(attribute, one boolean for each log) from (log_id, name): which logs have an attribute."""
    table = names.groupBy(F.col("name").alias("attribute")).pivot("log_id", logs).agg(F.max(F.lit(True)))
    return table.select("attribute", *[F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(c) for c in logs])


def top(rows: DataFrame, column: str, k: int, ties: list[str], descending: bool = True) -> DataFrame:
    """The k rows with the largest values, NULLs last."""
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return rows.orderBy(order, *ties).limit(k)


def _draw(seed: int, *columns: str):
    """An order that is random to the eye, and the same in every engine: the MD5 digest of a seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def example_traces(traces: DataFrame, n: int, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """n traces drawn by a hash, without replacement; the wanted columns, or all."""
    kept = traces.select("trace_idx", *(columns or [c for c in traces.columns if c != "trace_idx"]))
    return kept.orderBy(_draw(seed, "trace_idx"), "trace_idx").limit(n)


def example_events(events: DataFrame, n: int, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """One event drawn from each of n drawn traces; the wanted columns, or all."""
    drawn = example_traces(events.select("trace_idx").distinct(), n, seed)
    own = events.join(F.broadcast(drawn.select("trace_idx")), "trace_idx")
    one = own.groupBy("trace_idx").agg(F.min_by(F.struct(*own.columns), F.struct(_draw(seed, "trace_idx", "event_idx"), F.col("event_idx"))).alias("e")).select("e.*")
    return one.select("trace_idx", "event_idx", *columns) if columns else one


def ranked_values(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(by, rank from 0, value): sorted values of each side, for curves."""
    order = Window.partitionBy(by).orderBy(column)
    return rows.select(by, (F.row_number().over(order) - 1).alias("rank"), F.col(column).alias("value"))
