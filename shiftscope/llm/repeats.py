"""Substring dedup with repeated-phrase automata: words in windows of 35 that occur more than once are removed.

1. Texts that are equal are one text with a number of copies. Every window is named after the least of the hashes of its
   29 runs of seven words, its anchor. Neighbouring windows mostly share an anchor, so a text falls into segments: the
   windows of one anchor, two in thirty places. Equal windows have equal anchors, wherever they stand.
2. Anchors are counted; one that occurs once has no recurring window and goes no further. Segments of all others are
   counted by (anchor, words). One text that has a segment, its home, hands out its words, and where an anchor has a
   segment that occurs once, hashes of windows are counted: all passages that recur are confirmed before any automaton
   is made. A count that is 1 carries its only place along, so what is unique returns to its segment without a join of hot keys.
3. The runs of confirmed windows of a segment are its phrases. Texts are dealt into shards of SHARD_BYTES; a shard gets
   the phrases of the anchors that its texts have, compiles them into an Aho-Corasick automaton, and streams its texts
   through it. Phrases are compared word by word there, and every occurrence is found, as a phrase lies within the
   segment of its anchor. Work and data moved grow with the texts, not with texts times shards.

An automaton reads two characters for a word, numbered within the shard: its nodes then have few children, which the
library searches one after the other.

Confirmed windows are compared as two 64-bit hashes (the anchor's and the window's), made of word hashes; a window of n
is wrongly taken for recurring with a chance of n / 2^128, but for equal hashes of different words (v * v / 2^65 for v
words). The automaton compares words.

Cases: a null or empty text, or one of fewer than 35 words, loses nothing. Windows are judged on the input, not on
what is left: both of two copies lose all their words. Texts that overlap themselves count as any. Rows are decided by
their text alone, so ids may be null or repeated. No rows: no rows. Other columns pass unchanged; helper columns are
named __rep_*.
"""

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import aside, mark, release, ship, written
from shiftscope.llm._text import _FACTORS, SPACED, chunks, mix, span_hashes, word_bounds

WINDOW = 35
GRAM = 7
#: Runs of GRAM words in a window.
RUNS = WINDOW - GRAM + 1
#: Bytes of distinct texts in a shard: its texts and its automaton (at most about 200 MB) are in memory together.
SHARD_BYTES = 1 << 20

#: Anchors of more than all segments / HOT_ANCHORS are joined by broadcast.
HOT_ANCHORS = 1_000


def _run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out += hashes[i : i + len(out)] * _FACTORS[i]
    return mix(out)


def _least(grams: np.ndarray) -> np.ndarray:
    """For each window the place of its least run, the first of equal ones."""
    value, place, width = grams, np.arange(len(grams)), 1
    while width < RUNS:
        step = min(width, RUNS - width)
        left, right = value[: len(value) - step], value[step:]
        later = right < left
        value, place = np.where(later, right, left), np.where(later, place[step:], place[: len(place) - step])
        width += step
    return place


def segments(hashes: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, windows, hash of the anchor, hash of the words) of each segment; words are counted over all rows."""
    if len(hashes) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = _run_hashes(hashes, GRAM)
    anchor = _least(grams)
    row = np.repeat(np.arange(len(by_row) - 1), np.diff(by_row))
    inside = row[: len(anchor)] == row[WINDOW - 1 :]
    opens = inside.copy()
    opens[1:] &= ~(inside[:-1] & (anchor[1:] == anchor[:-1]) & (row[1 : len(anchor)] == row[: len(anchor) - 1]))
    first = np.flatnonzero(opens)
    # a segment ends before the next one, or with its row's last window
    last_window = by_row[row[first] + 1] - WINDOW
    n = np.minimum(np.append(first[1:], len(anchor)), last_window + 1) - first
    words, total = n + WINDOW - 1, np.zeros(len(first), np.uint64)
    for i in range(int(words.max()) if len(words) else 0):
        own = words > i
        total[own] += hashes[first[own] + i] * _FACTORS[i]
    return row[first], first, n, grams[anchor[first]], mix(total + words.astype(np.uint64))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data, offsets in chunks(batch.column(2)):
            first, end = word_bounds(data, offsets, SPACED)
            by_row = np.searchsorted(first, offsets)
            row, at, n, anchor, words = segments(span_hashes(data, first, end), by_row)
            own = pa.array(row + start)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(own),
                    batch.column(1).take(own),
                    pa.array((at - by_row[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(words.view(np.int64)),
                ],
                ["id", "copies", "at", "n", "anchor", "words"],
            )


_PASSAGES = "anchor long, words long, copies long, windows array<long>, passage binary"


def _passages(key: tuple, texts: pa.Table, wanted: pa.Table) -> pa.Table:
    """The windows' hashes and the words of the wanted segments of a shard's texts."""
    names = ["anchor", "words", "copies", "windows", "passage"]
    by_text: dict[int, list[int]] = {}
    ids, at, n = (wanted.column(c).to_numpy() for c in ("id", "at", "n"))
    counts = wanted.column("count_windows").is_valid().to_numpy(zero_copy_only=False)
    for i, own in enumerate(ids.tolist()):
        by_text.setdefault(own, []).append(i)
    order, windows, passages = [], [], []
    texts = texts.select(["id", "text"]).combine_chunks()
    for batch in texts.to_batches():
        for start, data, offsets in chunks(batch.column(1)):
            first, end = word_bounds(data, offsets, SPACED)
            by_row = np.searchsorted(first, offsets)
            runs = _run_hashes(span_hashes(data, first, end), WINDOW).view(np.int64)
            raw = data.tobytes()
            for r, own in enumerate(batch.column(0).slice(start, len(offsets) - 1).to_pylist()):
                for i in by_text.get(own, ()):
                    a = int(by_row[r]) + int(at[i])
                    b = a + int(n[i])
                    order.append(i)
                    windows.append(runs[a:b] if counts[i] else runs[:0])
                    passages.append(raw[first[a] : end[b + WINDOW - 2]])
    taken = wanted.take(pa.array(order, pa.int64()))
    ends = np.concatenate(([0], np.cumsum([len(w) for w in windows]))).astype(np.int32)
    flat = np.concatenate(windows) if windows else np.zeros(0, np.int64)
    columns = [taken.column(c).combine_chunks() for c in names[:3]]
    return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(passages, pa.binary())], names)


def _phrases(passage: bytes, unique: int) -> Iterator[list[bytes]]:
    """The words of each run of windows of a passage that are not unique; bit k of unique is set if window k is."""
    words = passage.split()
    n, k = len(words) - WINDOW + 1, 0
    while k < n:
        if unique >> k & 1:
            k += 1
            continue
        last = k
        while last + 1 < n and not unique >> (last + 1) & 1:
            last += 1
        yield words[k : last + WINDOW]
        k = last + 1


class Phrases:
    """An automaton over the phrases of a shard, which finds all their occurrences in a text's words."""

    def __init__(self, passages: Iterator[tuple[bytes, int]]):
        phrases = [p for passage, unique in passages for p in _phrases(passage, unique)]
        numbers: dict[bytes, int] = {}
        for p in phrases:
            for w in p:
                numbers.setdefault(w, len(numbers))
        base = math.isqrt(len(numbers)) + 1
        # first characters and second ones are different, so a match begins with a word
        self.codes = {w: chr(1 + i // base) + chr(base + 2 + i % base) for w, i in numbers.items()}
        self.automaton = ahocorasick.Automaton()
        for p in phrases:
            self.automaton.add_word("".join(map(self.codes.__getitem__, p)), len(p))
        self.any = bool(phrases)
        if self.any:
            self.automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Whether each word is part of an occurrence of a phrase."""
        edges = np.zeros(len(words) + 1, np.int64)
        if self.any:
            get = self.codes.get
            coded = "".join([get(w, "\0\0") for w in words])
            for end, length in self.automaton.iter(coded):
                last = end // 2 + 1
                edges[last - length] += 1
                edges[last] -= 1
        return np.cumsum(edges[:-1]) > 0


def _remover(with_text: bool):
    def removed(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        found = Phrases(zip(known.column("passage").to_pylist(), known.column("unique").to_pylist(), strict=True))
        n_words, n_removed, kept = [], [], []
        for batch in texts.select(["text"]).to_batches():
            for text in batch.column(0):
                words = text.as_py().encode().split()
                gone = found.covered(words)
                rest = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(rest.decode() if with_text else hashlib.sha256(rest).hexdigest())
        return pa.Table.from_arrays([texts.column("key").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])

    return removed


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards))


def confirmed(texts: DataFrame, likely: DataFrame, shards: int) -> DataFrame:
    """(anchor, words, passage, unique): the segments with a window that recurs, and a bit for each window that does not.

    All windows of a segment that occurs twice recur. Only where an anchor has a segment that occurs once are windows counted.
    """
    spark, start = texts.sparkSession, mark(texts.sparkSession)
    each = written(likely.groupBy("anchor", "words").agg(F.sum("copies").alias("copies"), F.min(F.struct("id", "at", "n")).alias("home")), "repeat-segments")
    mixed = each.groupBy("anchor").agg(F.min("copies").alias("least")).filter("least = 1").select("anchor", F.lit(True).alias("count_windows"))
    homes = each.select("anchor", "words", "copies", "home.*").join(mixed, "anchor", "left").withColumn("shard", _shard(shards))
    made = texts.select("id", "shard", "text").groupBy("shard").cogroup(homes.groupBy("shard")).applyInArrow(_passages, _PASSAGES)
    made = written(made, "repeat-passages")
    windows = made.select("anchor", "words", "copies", F.posexplode("windows").alias("k", "window"))
    # of a window that occurs once, words and k are the only ones
    counted = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n"), F.min("words").alias("words"), F.min("k").alias("k"))
    alone = counted.filter("n = 1").groupBy("anchor", "words").agg(F.sum(F.expr("shiftleft(1L, k)")).alias("unique"))
    marked = made.join(alone, ["anchor", "words"], "left").withColumn("unique", F.coalesce("unique", F.lit(0).cast("long")))
    recurs = (F.size("windows") == 0) | (F.col("unique") != F.expr("shiftleft(1L, size(windows)) - 1"))
    phrases = written(marked.filter(recurs).select("anchor", "words", "passage", "unique"), "repeat-phrases")
    release(spark, start, (phrases,))
    return phrases


def find_repeats(docs: DataFrame, *, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept) of each distinct text: key is the MD5 of the text, kept its remaining words or their SHA-256."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    one = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = written(one.select("key", "text", "copies", F.octet_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")), "repeat-texts", "zstd")
    shards = max(1, math.ceil((texts.agg(F.sum("size")).first()[0] or 0) / SHARD_BYTES))
    texts = texts.withColumn("shard", _shard(shards))
    start = mark(docs.sparkSession)
    found = written(texts.select("id", "copies", "text").mapInArrow(_segment_rows, "id long, copies long, at int, n int, anchor long, words long"), "repeat-found", "zstd")
    several = written(found.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")).filter("all > 1").select("anchor", "rows"), "repeat-anchors")
    # anchors of many rows do not meet in one task; there are HOT_ANCHORS of them at most
    most = found.count() / HOT_ANCHORS
    hot = F.broadcast(several.filter(F.col("rows") > most).select("anchor"))
    others = several.filter(F.col("rows") <= most).select("anchor")
    likely = written(found.join(hot, "anchor").unionByName(found.join(hot, "anchor", "left_anti").join(others, "anchor")), "repeat-likely")
    release(docs.sparkSession, start, (likely,))
    phrases = confirmed(texts, likely, shards)
    needed = likely.select(_shard(shards).alias("shard"), "anchor", "words").distinct().join(phrases, ["anchor", "words"]).select("shard", "passage", "unique")
    return texts.select("key", "text", "shard").groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(_remover(with_text), "key binary, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, *, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with __rep_words, __rep_removed and __rep_kept (the words that are left, or their SHA-256)."""
    docs, back = aside(docs, "__rep_")
    found = find_repeats(docs, text_col=text_col, with_text=with_text)
    found = found.select(F.col("key").alias("__rep_key"), F.col("n_words").alias("__rep_words"), F.col("n_removed").alias("__rep_removed"), F.col("kept").alias("__rep_kept"))
    keyed = docs.withColumn("__rep_key", F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))))
    return keyed.join(found, "__rep_key").select(*back, "__rep_words", "__rep_removed", "__rep_kept")
