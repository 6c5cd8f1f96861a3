"""Words of many texts at once, as arrays: NumPy over the bytes of an Arrow column.

A chunk is a run of texts of CHUNK_BYTES together, or one longer text. What is taken byte by byte is taken PIECE_BYTES at
a time, so a text of any length costs its own bytes, a lower-cased copy and 24 bytes a word, besides what a caller makes
of the words.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart together.
CHUNK_BYTES = 1 << 20
#: Bytes that temporary arrays are made of at a time.
PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words that stand between spaces, and of words of letters and digits (all of UTF-8 beyond ASCII).
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

#: Words of more bytes are hashed by BLAKE2.
LONG_WORD = 64
_SEED = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Factors of the words of a run, odd and without a pattern.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * _SEED) | np.uint64(1)


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, n + 1 offsets) of runs of rows. Nulls are empty; a long text is a run of its own."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        gone = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
        if (offsets[gone + 1] != offsets[gone]).any():
            yield from chunks(column.fill_null(""), chunk_bytes)
            return
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1)
        last = min(last, n)
        yield first, everything[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(low: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word of rows that are lower-cased already, or not to be."""
    firsts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(0, len(low), PIECE_BYTES):
        q = min(len(low), p + PIECE_BYTES)
        # with the byte before and the byte after, so that a word may cross pieces
        wide = np.zeros(q - p + 2, bool)
        a, b = max(0, p - 1), min(len(low), q + 1)
        wide[a - p + 1 : b - p + 1] = is_word[low[a:b]]
        inside, before, after = wide[1:-1], wide[:-2].copy(), wide[2:].copy()
        opened = offsets[np.searchsorted(offsets, p) : np.searchsorted(offsets, q)]
        closed = offsets[np.searchsorted(offsets, p, side="right") : np.searchsorted(offsets, q, side="right")]
        before[opened - p] = False
        after[closed - p - 1] = False
        firsts.append(np.flatnonzero(inside & ~before) + p)
        ends.append(np.flatnonzero(inside & ~after) + p + 1)
    return np.concatenate(firsts), np.concatenate(ends)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word, A-Z lower-cased, and n + 1 offsets of each row's words.

    Equal words have equal hashes. Hashes are not words: where a hit must be certain, callers compare the bytes.
    """
    low = LOWER[data]
    first, end = word_bounds(low, offsets, is_word)
    return span_hashes(low, first, end, salt), first, end, np.searchsorted(first, offsets)


def span_hashes(low: np.ndarray, first: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes at a time through a bijection, BLAKE2 for long spans.

    Another salt makes another hash, whose equal spans are others.
    """
    out = np.empty(len(first), np.uint64)
    if not len(first):
        return out
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    lanes = np.ndarray(len(low) + 1, "<u8", padded, strides=(1,))
    for p in range(0, len(first), PIECE_BYTES):
        start, length = first[p : p + PIECE_BYTES], end[p : p + PIECE_BYTES] - first[p : p + PIECE_BYTES]
        h = mix(length.astype(np.uint64) + np.uint64(int(_SEED) * (2 * salt + 1) % (1 << 64)))
        h = mix(h ^ (lanes[start] & _LANE[np.minimum(length, 8)]))
        for at in range(8, min(LONG_WORD, int(length.max())), 8):
            own = np.flatnonzero(length > at)
            h[own] = mix(h[own] ^ (lanes[start[own] + at] & _LANE[np.minimum(length[own] - at, 8)]))
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : start[i] + length[i]], digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
        out[p : p + PIECE_BYTES] = h
    return out


def ngrams(hashes: np.ndarray, row_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words within a row, offsets by row); a row of fewer words, but not none, is one run."""
    counts = np.diff(row_offsets)
    if not len(hashes):
        return hashes, np.zeros(len(row_offsets), np.int64)
    runs = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for i in range(n):
        runs += hashes[i : i + len(runs)] * _FACTORS[i]
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    row = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(row)) - out_offsets[row] + row_offsets[row]
    whole = counts[row] >= n
    out = np.zeros(len(row), dtype=np.uint64)
    out[whole] = mix(runs[at[whole]])
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        own = hashes[row_offsets[r] : row_offsets[r + 1]]
        out[out_offsets[r]] = mix(np.sum(own * _FACTORS[: len(own)], keepdims=True) + np.uint64(len(own)))[0]
    return out, out_offsets
