"""Audit of how filters act together: every order of the filters is replayed on every document.

Each document gets a bit for each of five filters that it fails. These rows are crossed with a broadcast table of the 120
orders, the first failing step of each order is computed, five steps are exploded, and conditional sums by source, order
and step are combined on the map side, so 600 sums a source and task are all that is shuffled. A filter's Shapley share is
the sum of what it removes over all orders.

The filters: A too few words, B too few distinct words, C too many capitals, D unwanted characters, E the text of a
document with a smaller id. E needs the smallest id of each text: texts are grouped by SHA-256 with a map-side minimum.
Texts of more than a thousandth of all rows (a thousand at most) are looked up in a broadcast table, all others by a
shuffled join, so no key of many rows is in one task.

Cases: a null or empty text has no words: it fails A only, and E if a smaller id has none either. A row without an id is
no copy and has no smaller one; rows that share id and text are not copies of each other. A null source is the empty
string. Labels are taken by id, a 1 among several counts; rows without an id or a label count as neither. No rows: no
rows. Other columns are not read.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import written

FILTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Texts of more than all rows / HOT_TEXTS rows are joined by broadcast: HOT_TEXTS rows at most.
HOT_TEXTS = 1_000


def failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A, B, C and D."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [
        n < 50,
        100 * distinct.cast("long") < 65 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def flagged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, fails, quality, toxic): a row for each document; bit k of fails is set if it fails filter k."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("text")))]
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"))
    # texts are read once; what follows is narrow
    rows = written(own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("fails")), "audit-flags")
    copies = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"), "audit-copies")
    most = rows.count() / HOT_TEXTS
    hot = copies.filter(F.col("n") > most).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    others = copies.filter(F.col("n") <= most).select(F.col("digest").alias("key"), "first")
    # rows of hot texts meet no other side: each has a key of its own, which is shorter than a digest
    alone = F.unhex(F.md5(F.concat("digest", F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))))
    known = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot"), alone).otherwise(F.col("digest")))
    known = known.join(others, "key", "left")
    copied = F.col("id") > F.coalesce("hot_first", "first")
    marks = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    fails = F.col("fails") + F.when(copied, 1 << 4).otherwise(0)
    return known.select("id", "part", fails.alias("fails")).join(marks, "id", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(flags: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from flagged()'s rows."""
    named = ["".join(p) for p in permutations(FILTERS)]
    table = [(i, name, *[1 << FILTERS.index(c) for c in name]) for i, name in enumerate(named)]
    orders = flags.sparkSession.createDataFrame(table, "ord int, filter_order string, " + ", ".join(f"f{k} int" for k in range(1, 6)))
    crossed = flags.crossJoin(F.broadcast(orders.drop("filter_order")))
    hit = lambda k: F.col("fails").bitwiseAND(F.col(f"f{k}")) != 0
    first = F.when(hit(1), 1).when(hit(2), 2).when(hit(3), 3).when(hit(4), 4).when(hit(5), 5).otherwise(6)
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"f{k}").alias("bit")) for k in range(1, 6)]))
    exploded = crossed.withColumn("first", first).select("part", "ord", "fails", "good", "toxic", "first", steps.alias("s"))
    step, bit, at = F.col("s.step"), F.col("s.bit"), F.col("first")
    sums = exploded.groupBy("part", "ord", step.alias("step"), bit.alias("bit")).agg(
        F.count_if(at > step).alias("kept"),
        F.count_if(at == step).alias("removed"),
        F.count_if((at < step) & (F.col("fails").bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(F.col("fails") == bit).alias("unique_fails"),
        F.count_if((at == step) & F.col("good")).alias("good_lost"),
        F.count_if((at == step) & F.col("toxic")).alias("toxic_lost"),
    )
    sums = written(sums, "audit-sums")
    shares = sums.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sums.join(shares, ["part", "bit"]).join(F.broadcast(orders.select("ord", "filter_order")), "ord").select("part", "filter_order", "step", *counts)


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each source, order and step, zeros included."""
    return replay(flagged(docs, labels, **columns))
