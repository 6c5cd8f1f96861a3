"""Quality by a regularised quadratic discriminant over document statistics.

Each text becomes 16 numbers (lengths, shares of kinds of bytes, repetition), passed through logarithms and square
roots so that they are near normal in a class. Class means and covariances come from sums that Spark adds up over a
bounded sample of labelled documents; a covariance is shrunk towards its diagonal and towards the unit matrix, and
its Cholesky factor is kept. The score is the logistic of the difference of the classes' log densities, tempered.

Cases: null and empty texts have the statistics of no words and get a score as any other. If one class or both have no
labelled rows the score is the share of the labels, 0.5 without any. Repeated rows get equal scores. No
rows: no rows. Texts are taken whole. Other columns pass unchanged; helper columns are named __quality_*, and a column of
such a name is replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import ship
from shiftscope.llm._fit import MAX_LABELLED, labelled_sample
from shiftscope.llm._text import PIECE_BYTES, SPACED, byte_class, chunks, mix, words

_UPPER = byte_class((0x41, 0x5A))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = byte_class((0x30, 0x39))
_STOP = byte_class((0x2C, 0x2C), (0x2E, 0x2E))
_BANG = byte_class((0x21, 0x21), (0x3F, 0x3F))
_BAR = byte_class((0x7C, 0x7C))
_MARK = byte_class((0x23, 0x2B), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
KINDS = (_UPPER, _LETTER, _DIGIT, _STOP, _BANG, _BAR, _MARK)
_LINE = byte_class((0x0A, 0x0A))
D = 16
SHRINK_DIAGONAL, SHRINK_UNIT = 0.1, 0.02
#: Log-density differences are overconfident: they are divided, bounded, and weighed by words / (words + FEW).
TEMPER, BOUND, FEW = 2.0, 10.0, 20.0


def _per_row(kind: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of a kind each row has; a long row is counted without an array of its length."""
    if len(offsets) == 2:
        return np.array([sum(np.count_nonzero(kind[data[p : p + PIECE_BYTES]]) for p in range(0, len(data), PIECE_BYTES))], float)
    run = np.concatenate(([0], np.cumsum(kind[data])))
    return (run[offsets[1:]] - run[offsets[:-1]]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, D)"""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    hashes, first, end, by_row = words(data, offsets, SPACED)
    counts = np.diff(by_row).astype(float)
    rows = np.repeat(np.arange(n), np.diff(by_row))
    per = lambda of, by: np.bincount(rows, of, minlength=n) / np.maximum(by, 1)
    length = (end - first).astype(float)
    mean = per(length, counts)
    spread = np.sqrt(np.maximum(0, per(length**2, counts) - mean**2))
    out = [np.log1p(counts), mean, spread]
    out += [np.sqrt(_per_row(kind, data, offsets) / np.maximum(size, 1)) for kind in KINDS]
    order = np.lexsort((hashes, rows))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][fresh], minlength=n)
    out.append(np.log1p(counts) - np.log1p(distinct))
    # runs of three words that were seen before in the row
    tri = mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else hashes[:0]
    tri_rows = rows[: len(tri)]
    whole = tri_rows == rows[2 : len(tri) + 2] if len(tri) else np.zeros(0, bool)
    tri, tri_rows = tri[whole], tri_rows[whole]
    order = np.lexsort((tri, tri_rows))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (tri[order][1:] != tri[order][:-1]) | (tri_rows[order][1:] != tri_rows[order][:-1])
    all_tri, new_tri = np.bincount(tri_rows, minlength=n), np.bincount(tri_rows[order][fresh], minlength=n)
    out.append(np.sqrt(1 - new_tri / np.maximum(all_tri, 1)) * (all_tri > 0))
    n_lines = _per_row(_LINE, data, offsets) + 1.0
    out.append(np.log1p(n_lines))
    out.append(np.log1p(counts / n_lines))
    out.append(np.sqrt(per((length > 14).astype(float), counts)))
    last = np.where(length > 0, data[np.maximum(end - 1, 0)], 0) if len(end) else np.zeros(0, np.uint8)
    out.append(np.sqrt(per((~_LETTER[last]).astype(float), counts)))
    return np.stack(out, axis=1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, cell, value): sums of x and x x' of a task's rows, x with a 1 in front."""
    sums = np.zeros((2, D + 1, D + 1))
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(batch.column(0)):
            x = np.concatenate((np.ones((len(offsets) - 1, 1)), statistics(data, offsets)), axis=1)
            own = labels[first : first + len(x)]
            for k in (0, 1):
                sums[k] += x[own == k].T @ x[own == k]
    cells = np.arange((D + 1) ** 2, dtype=np.int32)
    for k in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(sums[k].ravel())], ["label", "cell", "value"])


@dataclass
class Discriminant:
    share: float
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    log_dets: list[float]

    @classmethod
    def of(cls, sums: np.ndarray) -> "Discriminant":
        counts = sums[:, 0, 0]
        total = counts.sum()
        if min(counts) < 2:
            return cls(float(counts[1] / total) if total else 0.5, np.zeros(D), np.ones(D), [], [], [])
        centre = sums[:, 0, 1:].sum(axis=0) / total
        scale = np.sqrt(np.maximum(sums[:, np.arange(1, D + 1), np.arange(1, D + 1)].sum(axis=0) / total - centre**2, 1e-6))
        model = cls(float(counts[1] / total), centre, scale, [], [], [])
        for k in (0, 1):
            mean = sums[k, 0, 1:] / counts[k]
            cov = (sums[k, 1:, 1:] / counts[k] - np.outer(mean, mean)) / np.outer(scale, scale)
            cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov))
            cov = (1 - SHRINK_UNIT) * cov + SHRINK_UNIT * np.eye(D)
            lower = np.linalg.cholesky(cov)
            model.means.append((mean - centre) / scale)
            model.factors.append(np.linalg.inv(lower))
            model.log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        counts = np.expm1(x[:, 0])
        evidence = np.clip((density[1] - density[0]) / TEMPER, -BOUND, BOUND) * counts / (counts + FEW)
        return 1 / (1 + np.exp(-evidence - np.log(self.share / (1 - self.share))))


def _score(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Discriminant = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__quality_text"))
            scores = [model.score(statistics(data, offsets)) for _, data, offsets in chunks(column)]
            yield batch.set_column(batch.schema.get_field_index("__quality_score"), "__quality_score", pa.array(np.concatenate(scores) if scores else np.zeros(0)))

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int = 1, most: int = MAX_LABELLED) -> Discriminant:
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, modulus=modulus, held_out=held_out, most=most)
    cells = sample.mapInArrow(_moments, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, (D + 1) ** 2))
    for r in cells:
        sums[r.label, r.cell] = r.value
    return Discriminant.of(sums.reshape(2, D + 1, D + 1))


def scored(docs: DataFrame, model: Discriminant, *, text_col: str = "text") -> DataFrame:
    """docs with __quality_score, in [0, 1]."""
    ship(docs.sparkSession)
    ready = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__quality_")], F.col(text_col).alias("__quality_text"), F.lit(0.0).alias("__quality_score"))
    return ready.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), ready.schema).drop("__quality_text")
