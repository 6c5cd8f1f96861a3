"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents in a task, or PIECE_WORDS words of a longer one with the words of a window in common with
the next. Words become numbers of the benchmark's vocabulary; runs of such words that are long enough to hold a test
phrase make up the shard's text, with a separator after each (a phrase cannot cross a word that no benchmark item has,
so nothing else can match). The index has the suffixes' last column in a wavelet tree and every SAMPLE-th suffix
position. Each phrase of 13 words is searched backwards through the tree's ranks, all phrases at once; all occurrences
are located together by walking to sampled positions; spans are merged by document. Words are looked up by hash, and the
words of every occurrence are compared byte by byte with the benchmark's, so a hit is one of words.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words, one pass over the documents for each block.

Cases: null or empty texts have no words; so do items, which then match nothing. An item of fewer than 13 words is one
phrase. Repeated items count as items of their own id. Items with a null id take no part in the item list and
hit words as any other. Repeated rows get equal results. No rows: no rows; no items: nothing is hit. Texts are taken
whole. Other columns pass unchanged; helper columns are named __fm_*; find_spans() replaces columns of such names, the
others keep them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import aside, ship, written
from shiftscope.llm._text import ALNUM, LOWER, chunks, words

WINDOW = 13
SAMPLE = 8
#: Words of benchmark text in a block: some 22 bytes each are broadcast (measured), 44 MB a block.
BLOCK_WORDS = 2_000_000
#: Blocks that the tasks of one stage hold; then what was found is written.
BLOCKS_AT_ONCE = 4
#: Bytes of documents in a shard, and words of one that are indexed together.
SHARD_BYTES, PIECE_WORDS = 4 << 20, 1 << 19


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before at; arrays are taken pairwise."""
        start = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return symbol


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by suffix, by doubling the compared prefix; the text ends in a symbol of its own, the least."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        second = np.concatenate((rank[step:] + 1, np.zeros(min(step, n), np.int64)))
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """text: symbols from 1 up; a 0 is put at its end."""
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_order(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, max(1, int(n_symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]
        self.n = len(text)

    def search(self, sequence: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that start with each phrase: length symbols of sequence from begin on."""
        symbol = sequence[begin + length - 1]
        low, high = self.before[symbol], self.before[symbol + 1]
        live = np.flatnonzero(high > low)
        for column in range(length - 2, -1, -1):
            symbol = sequence[begin[live] + column].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, steps = np.full(len(rows), -1, np.int64), 0
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.sampled[here]
            found[open_[done]] = self.samples[self.sample_rank[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            symbol = self.tree.access(here)
            at[open_] = self.before[symbol] + self.tree.rank(symbol, here)
            steps += 1
        return found


class Phrases:
    """A block of the benchmark: its vocabulary, its items one after another as numbers of words, and its phrases by length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window, self.salt = window, 0
        column = pa.array([text for _, text in items], pa.string())
        while True:
            known: dict[int, bytes] = {}
            hashed, sizes, clash = [], [], False
            for _, data, offsets in chunks(column):
                hashes, first, end, by_row = words(data, offsets, ALNUM, self.salt)
                low = LOWER[data].tobytes()
                for h, a, b in zip(hashes.tolist(), first.tolist(), end.tolist(), strict=True):
                    clash |= known.setdefault(h, low[a:b]) != low[a:b]
                hashed.append(hashes)
                sizes.append(np.diff(by_row))
            if not clash:
                break
            self.salt += 1  # two words of one hash: another hash
        self.vocabulary = np.array(sorted(known), dtype=np.uint64)
        self.words = [known[h] for h in self.vocabulary.tolist()]
        every = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        self.sequence = (np.searchsorted(self.vocabulary, every) + 2).astype(np.int32)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        self.ids = [item for item, _ in items]
        self.by_size: list[tuple[int, np.ndarray, np.ndarray]] = []
        phrase = np.minimum(size, window)
        for k in np.unique(phrase[phrase > 0]):
            own = np.flatnonzero(phrase == k)
            count = size[own] - k + 1
            item = np.repeat(own, count)
            self.by_size.append((int(k), begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count), item.astype(np.int32)))
        self.least = min((k for k, _, _ in self.by_size), default=0)

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """words() of a chunk but for the hashes, then (first word, words, item) of each occurrence of a phrase in it."""
        hashes, first, end, by_row = words(data, offsets, ALNUM, self.salt)
        found = [np.zeros((3, 0), np.int64)]
        if len(hashes) and self.least:
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            number = np.where(self.vocabulary[at] == hashes, at + 2, 0)
            row_start = np.zeros(len(hashes), bool)
            row_start[by_row[:-1][by_row[:-1] < len(hashes)]] = True
            for p in range(0, len(hashes), PIECE_WORDS):
                q = p + PIECE_WORDS + self.window - 1
                found.append(self._in_piece(number[p:q], row_start[p:q]) + np.array([[p], [0], [0]]))
        start, size, item = np.concatenate(found, axis=1)
        if len(start):
            # a hash is no word: every word of an occurrence is compared with the vocabulary's
            touched = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(touched, start, 1)
            np.add.at(touched, start + size, -1)
            covered = np.flatnonzero(np.cumsum(touched[:-1]) > 0)
            low = LOWER[data]
            other = [w for w in covered if low[first[w] : end[w]].tobytes() != self.words[at[w]]]
            if other:
                wrong = np.zeros(len(hashes) + 1, np.int64)
                wrong[np.array(other) + 1] = 1
                wrong = np.cumsum(wrong)
                real = wrong[start + size] == wrong[start]
                start, size, item = start[real], size[real], item[real]
        return first, end, by_row, start, size, item

    def _in_piece(self, number: np.ndarray, row_start: np.ndarray) -> np.ndarray:
        # maximal runs of known words within a row
        known = number > 0
        begins = known & (row_start | ~np.concatenate(([False], known[:-1])))
        ends = known & (np.concatenate((row_start[1:], [True])) | ~np.concatenate((known[1:], [False])))
        first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = end - first >= self.least
        first, end = first[long], end[long]
        if not len(first):
            return np.zeros((3, 0), np.int64)
        size = end - first + 1
        text = np.ones(size.sum(), np.int64)
        place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size - first, size)
        inside = place < np.repeat(end, size)
        text[inside] = number[place[inside]]
        index = FMIndex(text, len(self.vocabulary) + 1)
        out = []
        for length, begin, item in self.by_size:
            low, high = index.search(self.sequence, begin, length)
            count = high - low
            rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append(np.stack([place[index.locate(rows)], np.full(len(rows), length), np.repeat(item, count)]))
        return np.concatenate(out, axis=1)


def _search(block) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in "abcd"]))
        for batch in batches:
            at = batch.schema.get_field_index
            column = batch.column(at("__fm_text"))
            counts = np.zeros(len(column), np.int64)
            spans = [[(s["a"], s["b"], s["c"], s["d"]) for s in old] for old in batch.column(at("__fm_spans")).to_pylist()]
            items = [set(old) for old in batch.column(at("__fm_items")).to_pylist()]
            for row0, data, offsets in chunks(column, SHARD_BYTES):
                first, end, by_row, start, size, item = phrases.occurrences(data, offsets)
                counts[row0 : row0 + len(offsets) - 1] = np.diff(by_row)
                rows = np.searchsorted(by_row, start, side="right") - 1
                for r, i in np.unique(np.stack([rows, item]), axis=1).T.tolist():
                    if phrases.ids[i] is not None:
                        items[row0 + r].add(phrases.ids[i])
                for r, a, b in np.unique(np.stack([rows, start, start + size]), axis=1).T.tolist():
                    spans[row0 + r].append((a - int(by_row[r]), b - int(by_row[r]), int(first[a] - offsets[r]), int(end[b - 1] - offsets[r])))
            out = batch.set_column(at("__fm_words"), "__fm_words", pa.array(counts))
            out = out.set_column(at("__fm_spans"), "__fm_spans", pa.array([[dict(zip("abcd", s, strict=True)) for s in merged(own)] for own in spans], kind))
            yield out.set_column(at("__fm_items"), "__fm_items", pa.array([sorted(own) for own in items], pa.list_(pa.string())))

    return run


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (first word, end word, first byte, end byte) as the fewest that cover the same words."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(set(spans)):
        if out and a <= out[-1][1]:
            x = out[-1]
            out[-1] = (x[0], max(x[1], b), x[2], max(x[3], d))
        else:
            out.append((a, b, c, d))
    return out


def find_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __fm_words (long), __fm_spans (merged; words a to b, bytes c to d of the text) and __fm_items (strings, sorted)."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(item_text_col, F.lit("")).alias("t")).filter("t != ''")
    weight = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-weight // (6 * block_words)))
    out = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__fm_")],
        F.col(text_col).alias("__fm_text"),
        F.lit(0).cast("long").alias("__fm_words"),
        F.array().cast("array<struct<a:long,b:long,c:long,d:long>>").alias("__fm_spans"),
        F.array().cast("array<string>").alias("__fm_items"),
    )
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = Phrases([(r.i, r.t) for r in own.collect()])
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(phrases)), out.schema)
        if k % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and k + 1 < blocks:
            out = written(out, "fm-found")
    return out.drop("__fm_text")


def hits() -> dict:
    n_hit = F.aggregate("__fm_spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return {"n_words": F.col("__fm_words"), "n_hit": n_hit, "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("__fm_words"))}


def clean_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the spans' bytes."""
    kept, at = [], 0
    for c, d in spans:
        kept.append(text[at:c])
        at = d
    return b"".join([*kept, text[at:]])


def excise(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs with the merged spans cut out of their texts; no document goes."""
    docs, back = aside(docs, "__fm_")
    found = find_spans(docs, benchmark, text_col=text_col, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans = batch.column(batch.schema.get_field_index("__fm_spans")).to_pylist()
            texts = [clean_text(t.encode(), [(s["c"], s["d"]) for s in own]).decode() if own else t for t, own in zip(batch.column(at).to_pylist(), spans, strict=True)]
            yield batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))

    return found.mapInArrow(cut, found.schema).select(*back)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones: those of which a twentieth or more of the words are in benchmark phrases."""
    docs, back = aside(docs, "__fm_")
    found = find_spans(docs, benchmark, text_col=text_col, **options)
    return found.filter(~hits()["contaminated"]).select(*back)
