"""Sharding as a two-pass external shuffle.

Pass 1 scatters the rows over buckets with a seeded hash of all their columns; the number of buckets follows from the
bytes, so that a bucket fits in memory. Pass 2 gathers a bucket and permutes it with shuffle(), Spark's Fisher-Yates. A
row's place is its bucket's offset plus its place in the bucket, and shards are equal runs of places: the row counts of
two shards differ by one at most, whatever the keys and sizes. Only DataFrame functions are used.

Buckets are dealt to tasks in order, so a task holds a run of places; write_shards() writes them as they lie, a folder for
each shard and its slots in the order of its files.

A bucket that outgrows its size SPLIT times holds many equal rows (a hash cannot part them). Such rows are numbered and
written once, and dealt by number to as many parts as they need; parts are buckets of their own.

The draws repeat: rows of a bucket are sorted before shuffle(), and buckets lie in a fixed order in a fixed number of
partitions, so a task that runs again after a lost executor makes the same permutation. (Which of several equal rows has
which place is no difference.)

Cases: a null text counts as empty; null ids and repeated ids are scattered as other rows are, by the rest of their
columns. Fewer rows than shards leave shards empty. No rows: no rows. Columns of any type that Spark can compare pass
unchanged, maps as well; columns of docs that are named as the shard or the slot are kept as `<name>_before`, with more of that ending where that name is taken. Helper
columns are named __shard_*.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.llm._cluster import small_side, written

#: Bytes of rows in a bucket, as long as MOST_BUCKETS of them hold all rows (2 TB); beyond that buckets grow, to 200 MB at
#: 100 TB. One bucket is held in memory at a time; the offsets of all buckets are broadcast, at most 32 MB.
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 500_000
#: Buckets of more than so many times their size are split.
SPLIT = 4
#: Buckets whose offsets are added up in one task.
OFFSETS = 4_096
MOST_PARTITIONS = 200_000


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _ordered(c: Column, kind: T.DataType) -> Column:
    """c with every map as an array of its entries, which can be hashed and compared."""
    if not _has_map(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_ordered(e["key"], kind.keyType).alias("key"), _ordered(e["value"], kind.valueType).alias("value"))))


def _restored(c: Column, kind: T.DataType) -> Column:
    if not _has_map(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _restored(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_restored(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return F.map_from_entries(F.transform(c, lambda e: F.struct(_restored(e["key"], kind.keyType).alias("key"), _restored(e["value"], kind.valueType).alias("value"))))


def _offsets(counts: DataFrame) -> DataFrame:
    """(__shard_bucket, __shard_at): the rows before each bucket, added up by groups of OFFSETS buckets and then over groups."""
    grouped = counts.withColumn("g", F.floor(F.col("__shard_bucket") / OFFSETS))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each OFFSETS buckets, or 16 GB of documents
    groups = grouped.groupBy("g").agg(F.sum("__shard_n").alias("n"))
    groups = groups.select("g", F.coalesce(F.sum("n").over(earlier(Window.orderBy("g"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("__shard_n").over(earlier(Window.partitionBy("g").orderBy("__shard_bucket"))), F.lit(0))
    return grouped.withColumn("inside", inside).join(groups, "g").select("__shard_bucket", (F.col("before") + F.col("inside")).alias("__shard_at"))


def shard(
    docs: DataFrame,
    n_shards: int = 24,
    *,
    size_col: str | None = None,
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = 7919,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """docs with shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard).

    size_col names a column of row sizes in bytes; without it the UTF-8 bytes of text_col count.
    """
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    size = F.col(f"`{size_col}`") if size_col else row_bytes(F.col(f"`{text_col}`"))
    cells = [_ordered(F.col(f"`{f.name}`"), f.dataType).alias(c) for c, f in zip(names, fields, strict=True)]
    rows = docs.select(size.alias("__shard_size"), *cells)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("__shard_size"), F.lit(0))).first()
    bucket_bytes = max(bucket_bytes, math.ceil(total / MOST_BUCKETS))
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = rows.withColumn("__shard_key", F.xxhash64(F.lit(seed), *names))
    bucket = F.pmod(F.col("__shard_key"), F.lit(buckets)).cast("long")

    def measured(of: DataFrame) -> DataFrame:
        return of.groupBy("__shard_bucket").agg(F.count(F.lit(1)).alias("__shard_n"), F.sum("__shard_size").alias("__shard_bytes"))

    scattered = scattered.withColumn("__shard_bucket", bucket)
    counts = written(measured(scattered), "shard-buckets")
    crowded = counts.filter(F.col("__shard_bytes") > SPLIT * bucket_bytes)
    # part 0 of bucket b is bucket b * parts, so buckets keep their order
    most = crowded.agg(F.max("__shard_bytes")).first()[0]
    if most:
        parts = math.ceil(most / bucket_bytes)
        hot = small_side(written(crowded.select("__shard_bucket"), "shard-crowded"))
        numbered = written(scattered.join(hot, "__shard_bucket").withColumn("__shard_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "shard-numbered")
        both = scattered.join(hot, "__shard_bucket", "left_anti").withColumn("__shard_part", F.lit(0).cast("long")).unionByName(numbered)
        scattered = both.withColumn("__shard_bucket", F.col("__shard_bucket") * parts + F.col("__shard_part")).drop("__shard_part")
        counts = written(measured(scattered), "shard-buckets")
        buckets *= parts
    offsets = small_side(written(_offsets(counts), "shard-offsets"))

    partitions = max(1, min(math.ceil(total / bucket_bytes), MOST_PARTITIONS))
    task = F.floor(F.col("__shard_bucket") * partitions / buckets).cast("int")
    gathered = (
        scattered.select(task.alias("__shard_task"), "__shard_bucket", F.struct("__shard_key", *names).alias("__shard_row"))
        .repartitionById(partitions, "__shard_task")
        .groupBy("__shard_task", "__shard_bucket")
        .agg(F.sort_array(F.collect_list("__shard_row")).alias("__shard_rows"))
        .sortWithinPartitions("__shard_bucket")
        .select("__shard_bucket", F.shuffle("__shard_rows", seed).alias("__shard_rows"))
    )
    placed = gathered.select("__shard_bucket", F.posexplode("__shard_rows").alias("__shard_pos", "__shard_row")).join(offsets, "__shard_bucket")
    place = F.col("__shard_at") + F.col("__shard_pos")
    # the first `longer` shards have one row more
    each, longer = divmod(n, n_shards)
    head = longer * (each + 1)
    number = F.when(place < head, F.floor(place / F.lit(each + 1))).otherwise(longer + F.floor((place - head) / F.lit(max(each, 1))))
    slot = F.when(place < head, place % F.lit(each + 1)).otherwise((place - head) % F.lit(max(each, 1)))
    named = {}
    for taken in (shard_col, slot_col):
        free = f"{taken}_before"
        while free in docs.columns or free in (shard_col, slot_col):
            free += "_before"
        named[taken] = free
    kept = [_restored(F.col(f"__shard_row.{c}"), f.dataType).alias(named.get(f.name, f.name)) for c, f in zip(names, fields, strict=True)]
    return placed.select(*kept, number.cast("int").alias(shard_col), slot.cast("long").alias(slot_col))


def write_shards(sharded: DataFrame, path: str, *, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """shard()'s rows as Parquet, a folder for each shard.

    A task of shard() holds a run of places in order, so a folder's files, sorted by name, and the rows in them follow its
    slots. No further shuffle is needed, and no shard is written by one task alone.
    """
    sharded.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
