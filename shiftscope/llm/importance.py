"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target texts.

Features are runs of one to three words, hashed into 10,000 buckets. Two passes read the texts as Arrow batches. The
first adds each partition's features up in one vector of 10,000 counts (np.bincount), and treeReduce adds the vectors;
the driver gets one vector and makes a gain of each bucket. The second gathers the broadcast gains of a document's
features and sums them by document (np.bincount with weights). Gumbel noise, drawn by a hash of the id, is added, and
the highest scores are a sample without replacement: their ranks are places in a table that is sorted by range.

A feature's CRC is put together from those of its words: what the register holds after `a b` is what it holds after `a `,
moved on by the bytes of b, XORed with that of b alone. So no feature is ever built as a string.

Cases: a null or empty text, or one without words, has no features and weight 0; it has a score, and is not drawn. A null
id hashes as the empty string, and comes last among ties. Rows that share an id share their noise; rows that are equal in
score and id are ranked by features and weight, and share those ranks in any order. No documents: no rows. No target texts: all
target counts are 0. Weights are sums of whole numbers, exact below 2^53. Columns of docs pass unchanged; helper columns
are named __imp_*.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import aside, ship, small_side, written
from shiftscope.llm._text import ALNUM, LOWER, chunks, word_bounds

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Words whose features are made together.
WORDS = 1 << 18
#: Rows of scores (not of texts) that a task sorts.
SORTED_ROWS = 4_000_000
#: Vectors (80 KB each) that are merged in one task, and by the driver at the end.
FAN_IN = 64

#: Words of more bytes are taken one by one by zlib.
LONG_WORD = 64
#: The reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_STEP = _byte_table()


def _zeros_tables() -> np.ndarray:
    """For 0 to LONG_WORD zero bytes and each byte of the register: what becomes of it."""
    now = np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
    tables = [now]
    for _ in range(LONG_WORD):
        now = _STEP[now & 255] ^ (now >> np.uint32(8))
        tables.append(now)
    return np.stack(tables).reshape(-1).astype(np.uint32)


_ZEROS = _zeros_tables()


def _moved(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers after length zero bytes each."""
    at = np.minimum(length, LONG_WORD) << 10
    out = (
        _ZEROS[at + (register & 255)]
        ^ _ZEROS[at + 256 + ((register >> np.uint32(8)) & 255)]
        ^ _ZEROS[at + 512 + ((register >> np.uint32(16)) & 255)]
        ^ _ZEROS[at + 768 + (register >> np.uint32(24))]
    )
    for i in np.flatnonzero(length > LONG_WORD):
        # zlib takes long runs, a block at a time
        value, left = int(register[i]) ^ 0xFFFFFFFF, int(length[i])
        while left:
            block = min(left, 1 << 16)
            value, left = zlib.crc32(bytes(block), value), left - block
        out[i] = value ^ 0xFFFFFFFF
    return out


def word_registers(low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the CRC register holds after the bytes of each word, where it held 0 before."""
    length = end - first
    register = np.zeros(len(first), np.uint32)
    order = np.argsort(-length, kind="stable")
    short = order[length[order] <= LONG_WORD]
    sizes = length[short]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        own = short[: np.searchsorted(-sizes, -k, side="left")]
        register[own] = _STEP[(register[own] ^ low[first[own] + k]) & 255] ^ (register[own] >> np.uint32(8))
    for i in np.flatnonzero(length > LONG_WORD):
        register[i] = zlib.crc32(low[first[i] : end[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return register


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, rows, buckets): a row and a bucket for each feature, a block of words at a time."""
    for start, data, offsets in chunks(column):
        low = LOWER[data]
        first, end = word_bounds(low, offsets, ALNUM)
        by_row = np.searchsorted(first, offsets)
        counts = np.diff(by_row)
        row = np.repeat(np.arange(len(counts)), counts)
        yield start, counts, row[:0], row[:0]
        for p in range(0, len(first), WORDS):
            # with the words before, for the features that end in this block
            a, b = max(0, p - LONGEST + 1), min(len(first), p + WORDS)
            registers, length = word_registers(low, first[a:b], end[a:b]), end[a:b] - first[a:b]
            state = np.full(b - a, _ONES, np.uint32)
            for n in range(LONGEST):
                if n:
                    # a space, and the next word, which must be of the same row
                    state = _STEP[(state[:-1] ^ np.uint32(0x20)) & 255] ^ (state[:-1] >> np.uint32(8))
                state = _moved(state, length[n:]) ^ registers[n:]
                last = np.arange(a + n, b)
                own = (last >= p) & (row[last] == row[last - n])
                yield start, counts[:0], row[last[own]], (state[own] ^ _ONES).astype(np.int64) % BUCKETS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, _, buckets in features(batch.column(0)):
            total += np.bincount(buckets, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def _added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """The features of all texts in each bucket: one vector a partition, merged FAN_IN at a time."""
    ship(texts.sparkSession)
    vectors = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_counts, "counts binary").rdd.map(lambda r: bytes(r[0]))
    partitions = vectors.getNumPartitions()
    if not partitions:
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, math.ceil(math.log(partitions, FAN_IN)))
    return np.frombuffer(vectors.treeReduce(_added, depth), np.int64)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), one added to each count."""
    all_own, all_target = float(own.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_own / ((s + 1.0) * all_target))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.float64)


def scored(docs: DataFrame, bucket_gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """docs with __imp_words, __imp_features, __imp_weight and __imp_score (long)."""
    spark = docs.sparkSession
    ship(spark)
    broadcast = spark.sparkContext.broadcast(bucket_gains)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.float64)
            for start, counts, rows, buckets in features(batch.column(0)):
                n_words[start : start + len(counts)] += counts
                if len(rows):
                    base, low = start + int(rows[0]), int(rows[0])
                    made = np.bincount(rows - low)
                    n_features[base : base + len(made)] += made
                    weight[base : base + len(made)] += np.bincount(rows - low, weights=broadcast.value[buckets])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words), pa.array(n_features), pa.array(weight.astype(np.int64))], out.names)

    docs, back = aside(docs, "__imp_")
    text = F.col(f"`{text_col}`").cast("string").alias("__imp_text")
    given = docs.select(text, "*")
    out = docs.schema
    for name in ("__imp_words", "__imp_features", "__imp_weight"):
        out = out.add(name, "long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return given.mapInArrow(weighed, out).select(*back, "__imp_words", "__imp_features", "__imp_weight", (F.col("__imp_weight") + noise).alias("__imp_score"))


def ranked(rows: DataFrame, *, id_col: str = "doc_id", percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored()'s rows, which should be narrow, with __imp_rank: 1, 2, ... of the drawn ones, null for others.

    Rows are sorted by range partitions and written once with their partition and place in it; a rank is that place and
    the rows of the partitions before.
    """
    eligible = F.col("__imp_words") >= least_words
    n, total = rows.agg(F.count_if(eligible), F.count(F.lit(1))).first()
    order = [eligible.desc(), F.col("__imp_score").desc(), F.col(f"`{id_col}`").asc_nulls_last(), F.col("__imp_features"), F.col("__imp_weight")]
    parts = max(1, math.ceil(total / SORTED_ROWS))
    place = F.monotonically_increasing_id()
    # both numbers are columns of the written table, so no later task can see them otherwise
    table = written(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__imp_part", F.shiftright(place, 33)).withColumn("__imp_place", place.bitwiseAND(F.lit((1 << 33) - 1))),
        "importance-sorted",
    )
    counts = table.groupBy("__imp_part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each SORTED_ROWS rows: the driver adds them up
    before, at = [], 0
    for part, size in sorted((r[0], r[1]) for r in counts.collect()):
        before.append((part, at))
        at += size
    offsets = small_side(written(table.sparkSession.createDataFrame(before, "__imp_part long, __imp_before long"), "importance-offsets"))
    rank = F.col("__imp_before") + F.col("__imp_place") + 1
    drawn = eligible & (rank <= F.lit(percent * n // 100))
    return table.join(offsets, "__imp_part").withColumn("__imp_rank", F.when(drawn, rank)).drop("__imp_part", "__imp_place", "__imp_before")


def fit(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text") -> np.ndarray:
    return gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, seed: int = 42) -> DataFrame:
    """The rows of docs that are drawn, with their columns.

    Texts are not sorted or shuffled: the lowest drawn score and id are found on narrow rows, and docs are filtered by
    them. Rows that are equal to the last drawn one in score and id stay as well.
    """
    bucket_gains = fit(docs, target, text_col=text_col)
    narrow = scored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), bucket_gains, id_col="id", seed=seed).drop("text")
    last = ranked(narrow, id_col="id", percent=percent).filter("__imp_rank IS NOT NULL").orderBy(F.col("__imp_rank").desc()).limit(1).collect()
    docs, back = aside(docs, "__imp_")
    rows = scored(docs, bucket_gains, id_col=id_col, text_col=text_col, seed=seed)
    if not last:
        return rows.limit(0).select(*back)
    score, key = F.col("__imp_score"), F.col(f"`{id_col}`")
    among = key.isNotNull() & (key <= F.lit(last[0]["id"])) if last[0]["id"] is not None else F.lit(True)
    return rows.filter((F.col("__imp_words") >= LEAST_WORDS) & ((score > last[0]["__imp_score"]) | ((score == last[0]["__imp_score"]) & among))).select(*back)


def importance(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document."""
    bucket_gains = fit(docs, target)
    rows = scored(docs.select("doc_id", "text"), bucket_gains).drop("text")
    named: list[Column] = [F.col(f"__imp_{c}").alias(n) for c, n in (("features", "n_features"), ("weight", "weight"), ("score", "score"), ("rank", "rank"))]
    return ranked(rows).select("doc_id", *named)
