"""Language identification with bit-sliced Bloom filters of byte n-grams.

One Bloom filter per language, kept crosswise: a slot holds a mask with one bit for each language, so the AND of an
n-gram's slots gives all languages that have it. A text's hits are counted per language, a language's false positives
are taken off by the rate that its share of set bits implies, and the largest corrected count decides.

Texts are lower-cased in ASCII, and runs of bytes that are neither ASCII letters nor beyond ASCII become one space.
Filters hold the n-grams most frequent in a sample of texts of each language, drawn by a hash: SAMPLE_TEXTS texts a
language in expectation and GRAMS n-grams at most. Training rows are those outside the held-out fold with a language.
Spark counts the n-grams, ranks them (in two steps, so that no language is ranked in one task whole) and sets the
filters' bits; what reaches the driver is the filter itself, of MAX_FILTER_BYTES at most.

Cases: null texts and texts without a letter are `und` with score 0. A text with no known n-gram gets the most
frequent language, with the score 1 / languages. Ties go to the language first by code point. With nothing to
learn from every text is `und`; a language with one text learns that text's n-grams. Repeated rows get equal results.
No rows: no rows. Texts are taken whole, n-grams PIECE_BYTES at a time. Other columns pass unchanged; helper columns are
named __lang_*, and a column of such a name is replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.llm._cluster import mark, release, ship, written
from shiftscope.llm._fit import remainder
from shiftscope.llm._text import LOWER, PIECE_BYTES, byte_class, chunks, mix

SIZES = (3, 4)
SAMPLE_TEXTS = 1_500
GRAMS = 12_000
#: N-grams are left out that make up no more than this share of their language's sample.
LEAST_SHARE = 2e-7
HASHES = 3
#: Slots for each n-gram that is put in, at least.
ROOM = 12
#: Filters of more bytes than this are refused with an error.
MAX_FILTER_BYTES = 256 << 20
#: Parts in which a language's n-grams are ranked first.
RANK_PARTS = 32

_LETTER = byte_class((0x61, 0x7A), (0x80, 0xFF))
_SPACE = 0x20


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (hash of each n-gram, its row), within runs of letters with a space on either side."""
    if len(offsets) == 2:
        kept, own = _kept(data), None
    else:
        letter = _LETTER[LOWER[data]]
        rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        keep = letter.copy()
        # the first byte after a letter stays as the space that ends the word, and every row starts with one
        keep[1:] |= letter[:-1] & (rows[1:] == rows[:-1])
        kept, own = np.where(letter, LOWER[data], np.uint8(_SPACE))[keep], rows[keep]
        filled = np.unique(own)
        at = np.searchsorted(own, filled)
        kept, own = np.insert(kept, at, _SPACE), np.insert(own, at, filled)
    for size in SIZES:
        for p in range(0, len(kept) - size + 1, PIECE_BYTES):
            n = min(PIECE_BYTES, len(kept) - size + 1 - p)
            code = np.zeros(n, np.uint64)
            for i in range(size):
                code = code * np.uint64(256) + kept[p + i : p + i + n]
            if own is None:
                yield mix(code + np.uint64(size << 56)), np.zeros(n, np.int32)
            else:
                same = own[p : p + n] == own[p + size - 1 : p + n + size - 1]
                yield mix(code[same] + np.uint64(size << 56)), own[p : p + n][same]


def _kept(data: np.ndarray) -> np.ndarray:
    """The letters of one text, with a space before and after each run."""
    parts = [np.array([_SPACE], np.uint8)]
    before = False
    for p in range(0, len(data), PIECE_BYTES):
        low = LOWER[data[p : p + PIECE_BYTES]]
        letter = _LETTER[low]
        keep = letter | np.concatenate(([before], letter[:-1]))
        parts.append(np.where(letter, low, np.uint8(_SPACE))[keep])
        before = bool(letter[-1])
    return np.concatenate(parts) if len(parts) > 1 and sum(map(len, parts)) > 1 else np.zeros(0, np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language number, n-gram, count) of a task's texts, batch by batch."""
    for batch in batches:
        languages = batch.column(0).to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(batch.column(1)):
            for hashes, rows in _grams(data, offsets):
                lang = languages[first + rows]
                for k in np.unique(lang):
                    found, n = np.unique(hashes[lang == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["k", "gram", "n"])


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # (planes, slots) of 64-bit masks
    false_rate: np.ndarray
    default: int

    @staticmethod
    def shape(languages: int, most: int) -> tuple[int, int]:
        """(planes of 64 languages, slots) for filters of `most` n-grams at most."""
        return -(-max(1, languages) // 64), 1 << int(np.ceil(np.log2(max(1, most) * HASHES * ROOM / 2)))

    @classmethod
    def of(cls, languages: list[str], table: np.ndarray, default: int) -> "Filters":
        bits = [np.count_nonzero(table[k // 64] & (np.uint64(1) << np.uint64(k % 64))) for k in range(len(languages))]
        return cls(languages, table, (np.array(bits, float) / table.shape[1]) ** HASHES, default)

    @staticmethod
    def slot(hashes: np.ndarray, h: int, slots: int) -> np.ndarray:
        return ((hashes >> np.uint64(21 * h)) % np.uint64(slots)).astype(np.int64) if slots <= 1 << 21 else (mix(hashes + np.uint64(h)) % np.uint64(slots)).astype(np.int64)

    def holding(self, hashes: np.ndarray) -> np.ndarray:
        """(planes, n) masks of the languages that have each n-gram."""
        masks = self.table[:, self.slot(hashes, 0, self.table.shape[1])]
        for h in range(1, HASHES):
            masks &= self.table[:, self.slot(hashes, h, self.table.shape[1])]
        return masks

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) corrected counts, and how many n-grams each row has."""
        n = len(offsets) - 1
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for hashes, rows in _grams(data, offsets):
            masks = self.holding(hashes)
            total += np.bincount(rows, minlength=n)
            known = np.flatnonzero(masks.any(axis=0))
            masks, rows = masks[:, known], rows[known]
            for k in range(len(self.languages)):
                has = masks[k // 64] & (np.uint64(1) << np.uint64(k % 64)) != 0
                hits[:, k] += np.bincount(rows[has], minlength=n)
        return np.maximum(0, (hits - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)), total


def _has_letter(column: pa.Array, first: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A))))
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for r in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[r] = any(map(str.isalpha, column[first + int(r)].as_py()))
    return found


def _predict(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__lang_text"))
            named, scores = [], []
            for first, data, offsets in chunks(column):
                lettered = _has_letter(column, first, data, offsets)
                if not filters.languages:
                    named += ["und"] * len(lettered)
                    scores += [0.0] * len(lettered)
                    continue
                counts, _ = filters.counts(data, offsets)
                sums = counts.sum(axis=1)
                best = np.where(sums > 0, counts.argmax(axis=1), filters.default)
                share = np.where(sums > 0, counts[np.arange(len(best)), best] / np.maximum(sums, 1e-9), 1 / len(filters.languages))
                named += [filters.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores += list(np.where(lettered, share, 0.0))
            out = batch.set_column(batch.schema.get_field_index("__lang_pred"), "__lang_pred", pa.array(named, pa.string()))
            yield out.set_column(batch.schema.get_field_index("__lang_score"), "__lang_score", pa.array(scores, pa.float64()))

    return run


def _bits(planes: int, slots: int) -> object:
    """(plane, slot, mask) of the bits that n-grams (k, gram) set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy().astype(np.int64)
            gram = batch.column(1).to_numpy().view(np.uint64)
            mask = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            for h in range(HASHES):
                yield pa.RecordBatch.from_arrays([pa.array((k // 64).astype(np.int32)), pa.array(Filters.slot(gram, h, slots)), pa.array(mask)], ["plane", "slot", "mask"])

    return run


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, sample_texts: int = SAMPLE_TEXTS, grams: int = GRAMS) -> Filters:
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & (remainder(id_col, modulus) != held_out))
    most_languages = (MAX_FILTER_BYTES // (8 * Filters.shape(1, grams)[1])) * 64
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"filters of more than {most_languages} languages would take more than {MAX_FILTER_BYTES} bytes")
    languages = sorted(sizes)
    if not languages:
        return Filters.of([], np.zeros((1, 1), np.uint64), 0)
    info = docs.sparkSession.createDataFrame([(x, k, min(1.0, sample_texts / sizes[x])) for k, x in enumerate(languages)], "lang string, k int, share double")
    drawn = rows.select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)).alias("u"), F.coalesce(text_col, F.lit("")).alias("text"))
    drawn = drawn.join(F.broadcast(info), "lang").filter(F.col("u") < F.col("share") * (1 << 30)).select("k", "text")
    counted = drawn.mapInArrow(_count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    start = mark(docs.sparkSession)
    counted = written(counted, "lang-grams")
    # one row a language
    totals = F.broadcast(counted.groupBy("k").agg((F.sum("n") * LEAST_SHARE).alias("least")))
    top = counted.join(totals, "k").filter("n > least").drop("least").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(RANK_PARTS)))
    for keys in (["k", "part"], ["k"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))
        top = top.withColumn("place", place).filter(F.col("place") <= grams)
    planes, slots = Filters.shape(len(languages), grams)
    bits = top.select("k", "gram").mapInArrow(_bits(planes, slots), "plane int, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    release(docs.sparkSession, start)
    table = np.zeros((planes, slots), np.uint64)
    table[bits.plane.to_numpy(np.int64), bits.slot.to_numpy(np.int64)] = bits["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters.of(languages, table, max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)))


def identify(docs: DataFrame, filters: Filters, *, text_col: str = "text") -> DataFrame:
    """docs with __lang_pred and __lang_score."""
    ship(docs.sparkSession)
    ready = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__lang_")], F.col(text_col).alias("__lang_text"), F.lit(None).cast("string").alias("__lang_pred"), F.lit(None).cast("double").alias("__lang_score"))
    return ready.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(filters)), ready.schema).drop("__lang_text")
