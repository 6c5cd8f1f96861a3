"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as a sum of one entry of each of BOOKS full-dimensional codebooks, each times the norm of what was
left before it. So every book codes a direction, at whatever scale the vector has got to: where many vectors lie close
together, what they share is soon coded, and the later books code what tells them apart. The books are trained by
k-means on the scaled residuals of a bounded sample, and every row is encoded by a beam search that keeps the BEAM best partial
sums over all books. The norms of the residuals and of the sum are stored with a code. A block of queries is scored against a task's codes
by lookup tables. A task goes through its codes in slices and keeps the SHORTLIST largest table scores of each query so
far; what reaches the least of them, equal scores included, is scored again exactly, in double precision on the original
vectors. Of n codes in random order a query so reranks SHORTLIST * (1 + ln(n / SHORTLIST)) in a task, besides ties. The
best of all tasks are the answer.

Queries come in blocks of at most QUERY_BLOCK, each of which is broadcast; the rows are never paired with themselves.
Equal vectors have equal codes, so all copies of a candidate are reranked, and are found in the order of their ids.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do vectors of
another dimension than the most frequent one, nor rows without an id. Vectors of any other size take part: each is
scaled by a power of two, which changes no cosine, before it is squared. Of rows that share a query's id the least vector is
the query; rows of its id and its vector are no candidates, rows of its id and another vector are. Fewer candidates than asked for: all of them. No rows: no rows. Other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.llm._cluster import ship, written

BOOKS, ENTRIES, BEAM = 16, 256, 4
#: Table scores of a query that a task keeps; what reaches the least of them is reranked.
SHORTLIST = 256
#: Components of vectors that are multiplied at a time in reranking.
RERANK_COMPONENTS = 1 << 22
#: Vectors that the codebooks are trained on, in expectation.
TRAINING = 8_192
#: 8 bytes a component: 4096 queries of 1024 dimensions take 32 MB.
QUERY_BLOCK = 4_096
#: Codes and queries scored at a time.
CODES = 2_048
QUERIES = 512


@dataclass
class Codebooks:
    books: np.ndarray  # (BOOKS, ENTRIES, dimension)

    @classmethod
    def trained(cls, sample: np.ndarray, seed: int = 9) -> "Codebooks":
        rng, books, left = np.random.default_rng(seed), [], sample.copy()
        for _ in range(BOOKS):
            rest, size = _directions(left)
            entries = rest[rng.choice(len(rest), ENTRIES, replace=len(rest) < ENTRIES)]
            for _ in range(8):
                near = (rest @ entries.T - 0.5 * (entries**2).sum(axis=1)).argmax(axis=1)
                sums = np.zeros_like(entries)
                np.add.at(sums, near, rest)
                counts = np.bincount(near, minlength=ENTRIES)
                entries = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rest[rng.choice(len(rest), ENTRIES)])
            near = (rest @ entries.T - 0.5 * (entries**2).sum(axis=1)).argmax(axis=1)
            left = size[:, None] * (rest - entries[near])
            books.append(entries)
        return cls(np.stack(books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, norms of what was left before each, norms of the sums) by beam search."""
        n, d = x.shape
        codes, sizes, rest = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, 0), np.float32), x[:, None, :].copy()
        for book in self.books:
            direction, size = _directions(rest)
            # entries are chosen in single precision; what is left is kept in double precision
            near = (book**2).sum(axis=1).astype(np.float32) - 2 * direction.astype(np.float32) @ book.T.astype(np.float32)
            error = ((size**2).astype(np.float32)[:, :, None] * (1 + near)).reshape(n, -1)
            best = np.argpartition(error, BEAM - 1, axis=1)[:, :BEAM]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(error, best, axis=1), axis=1), axis=1)
            parent, entry = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            size = size[rows, parent]
            rest = rest[rows, parent] - size[:, :, None] * book[entry]
            codes = np.concatenate((codes[rows, parent], entry[:, :, None].astype(np.uint8)), axis=2)
            sizes = np.concatenate((sizes[rows, parent], size[:, :, None].astype(np.float32)), axis=2)
        total = x - rest[:, 0]
        return codes[:, 0], sizes[:, 0], np.sqrt((total**2).sum(axis=1)).astype(np.float64)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors along the last axis at norm one, and their norms; what is zero stays so."""
    size = np.sqrt((x**2).sum(axis=-1))
    return x / np.where(size > 0, size, 1)[..., None], size


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(-1, dimension), dtype=np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two to a largest component of one half to one: exact, and safe to square."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(rows: DataFrame, *, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector as doubles) of the rows that take part, and their dimension."""
    as_double = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    kept = as_double.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = sizes.d if sizes else 0
    return kept.filter(F.size("v") == dimension), dimension


def _encode(shared, dimension: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, CODES):
                part = batch.slice(at, CODES)
                # in double precision, as residuals of vectors that lie close together get very small
                codes, sizes, norms = books.encode(_unit(_vectors(part.column(1), dimension)))
                packed = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (codes, sizes.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed, pa.array(norms)], ["id", "v", "code", "sizes", "norm"])

    return run


def index(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", training: int = TRAINING) -> tuple[DataFrame, Codebooks | None, int]:
    """(id, v, code, sizes, norm) of all rows that take part, the codebooks, and the dimension."""
    spark = rows.sparkSession
    ship(spark)
    kept, dimension = usable(rows, id_col=id_col, vector_col=vector_col)
    if not dimension:
        return kept.select("id", "v", F.lit(b"").alias("code"), F.lit(b"").alias("sizes"), F.lit(0.0).alias("norm")), None, 0
    n = kept.count()
    # drawn by the vector: repeated ones count once, so that a frequent one takes no codebook
    order = F.xxhash64(F.lit(3), "v")
    drawn = kept if n <= training else kept.filter(F.pmod(order, F.lit(1 << 62)) < int(training / n * (1 << 62)))
    sample = np.array([r.v for r in drawn.select("v").distinct().orderBy(order, "v").collect()], dtype=np.float64)
    books = Codebooks.trained(_unit(sample)) if len(sample) else Codebooks(np.zeros((BOOKS, ENTRIES, dimension)))
    coded = kept.mapInArrow(_encode(spark.sparkContext.broadcast(books), dimension), "id long, v array<double>, code binary, sizes binary, norm double")
    return written(coded, "ann-codes"), books, dimension


def _nearest(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, queries))
    own = queries[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k]


def _search(shared, dimension: int, k: int, shortlist: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, books = shared.value
        queries = _scaled(queries)
        norm_q = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norm_q[:, None]
        blocks = [slice(q, q + QUERIES) for q in range(0, len(query_ids), QUERIES)]
        # a row of a table holds the products of one entry with all queries of a block
        tables = [np.ascontiguousarray(np.einsum("bed,qd->beq", books.books, unit[own])) for own in blocks]
        top = [np.full((len(query_ids[own]), shortlist), -np.inf) for own in blocks]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for at in range(0, batch.num_rows, CODES):
                part = batch.slice(at, CODES)
                ids, vectors = part.column(0).to_numpy(), _scaled(_vectors(part.column(1), dimension))
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, BOOKS)
                sizes = np.frombuffer(b"".join(part.column(3).to_pylist()), "<f4").reshape(-1, BOOKS)
                norm = np.maximum(part.column(4).to_numpy(), 1e-9)
                norm_v = np.sqrt((vectors * vectors).sum(axis=1))
                found = [best]
                for i, own in enumerate(blocks):
                    rough = np.zeros((len(codes), tables[i].shape[2]))
                    for b in range(BOOKS):
                        rough += tables[i][b][codes[:, b]] * sizes[:, b, None]
                    rough = np.ascontiguousarray((rough / norm[:, None]).T)
                    same_q, same_r = np.nonzero(query_ids[own, None] == ids)
                    itself = (vectors[same_r] == queries[own][same_q]).all(axis=1)
                    rough[same_q[itself], same_r[itself]] = -np.inf
                    both = np.concatenate((top[i], rough), axis=1)
                    top[i] = np.partition(both, both.shape[1] - shortlist, axis=1)[:, -shortlist:]
                    likely = (rough >= top[i].min(axis=1)[:, None]) & (rough > -np.inf)
                    query, row = np.nonzero(likely)
                    query += own.start
                    for p in range(0, len(query), max(1, RERANK_COMPONENTS // dimension)):
                        q, r = (x[p : p + max(1, RERANK_COMPONENTS // dimension)] for x in (query, row))
                        exact = (vectors[r] * queries[q]).sum(axis=1) / (norm_v[r] * norm_q[q])
                        kept = _nearest(q, ids[r], exact, k)
                        found.append((q[kept], ids[r][kept], exact[kept]))
                if len(found) > 1:
                    best = tuple(np.concatenate(x) for x in zip(*found, strict=True))
                    kept = _nearest(*best, k)
                    best = tuple(x[kept] for x in best)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", shortlist: int = SHORTLIST, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query (a Column over `id`) holds."""
    spark = rows.sparkSession
    coded, books, dimension = index(rows, id_col=id_col, vector_col=vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dimension:
        return empty
    queries = coded.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n = queries.count()
    blocks = -(-n // query_block)
    found = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        block = own.orderBy("id").collect()
        if block:
            shared = spark.sparkContext.broadcast((np.array([r.id for r in block]), np.array([r.v for r in block], dtype=np.float64), books))
            part = coded.mapInArrow(_search(shared, dimension, k, shortlist), "query_id long, vec_id long, score double")
            found.append(written(part, "ann-found") if blocks > 1 else part)
    if not found:
        return empty
    everything = found[0]
    for part in found[1:]:
        everything = everything.unionAll(part)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = everything.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(nearest))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
