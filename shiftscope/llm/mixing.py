"""Mixing sources to target weights: every document is repeated so that its source reaches its target.

Words are counted per source, targets follow from the weights, and a document is emitted floor(rate) times
plus one further time with probability rate - floor(rate), drawn from a hash of its id and a seed. All steps
are DataFrame functions; the only shuffle is the sum per source, which is combined before it. The table of sources is
broadcast if it takes 64 MB at most; a larger one is joined by shuffle, where Spark splits a hot source.

Cases: a null or empty text has size 0 and its rows are taken 0 times if its source has no words at all. A null
source is a source of its own, ordered last. Rows that share an id share their draw. No rows: no rows. Other
columns pass unchanged; helper columns are named __mix_*; mix_plan() replaces columns of such names, mix() keeps them.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.llm._cluster import aside, small_side, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 digest: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(__mix_source, source_size, target) from (__mix_source, source_size).

    Targets are min(cap * size, level * weight) with one level for all, such that they add up to share * all
    sizes. That is where resharing what is above the caps by weight ends; the level is found from running sums
    over the sources in the order in which they reach their caps.
    """
    order = Window.orderBy(F.col("__mix_source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("__mix_w", F.element_at(pattern, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("__mix_cap", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("__mix_cap") / F.col("__mix_w"), F.col("__mix_source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = (
        weighed.withColumn("__mix_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__mix_level", (F.col("__mix_total") - F.coalesce(F.sum("__mix_cap").over(before), F.lit(0.0))) / F.sum("__mix_w").over(after))
        .withColumn("__mix_level", F.when(F.col("__mix_level") <= F.col("__mix_cap") / F.col("__mix_w"), F.col("__mix_level")))
        .withColumn("__mix_level", F.max("__mix_level").over(everything))
    )
    target = F.least(F.col("__mix_cap"), F.coalesce(F.col("__mix_level") * F.col("__mix_w"), F.col("__mix_cap")))
    return leveled.select("__mix_source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20_11,
) -> DataFrame:
    """docs with __mix_size, __mix_source_size, __mix_target and __mix_copies."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("__mix_")])
    sized = docs.withColumn("__mix_size", word_count(F.col(text_col)))
    sums = sized.groupBy(F.col(source_col).alias("__mix_source")).agg(F.sum("__mix_size").alias("source_size"))
    targets = written(source_targets(sums, weights, share, cap), "mix-targets")
    targets = targets.withColumnsRenamed({"source_size": "__mix_source_size", "target": "__mix_target"})
    joined = sized.join(small_side(targets), sized[source_col].eqNullSafe(targets["__mix_source"])).drop("__mix_source")
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(F.lit(0.0))
    extra = (uniform(seed, F.col(id_col)) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("__mix_copies", (F.floor(rate) + extra).cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them: the same columns, each row as often as it is taken."""
    docs, back = aside(docs, "__mix_")
    planned = mix_plan(docs, **options).withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies"))))
    return planned.select(*back)
