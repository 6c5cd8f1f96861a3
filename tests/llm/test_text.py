"""Words as arrays: against re, across pieces, for words that simple hashes confuse, and for very long texts."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from shiftscope.llm import _text, decontam, langid, neardup, quality, toxicity


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_across_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é\n\t.") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "A" * 90]
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("B", "b").replace("A", "a")) for t in texts]
    seen = {}
    for piece in (3, 7, 1 << 20):
        monkeypatch.setattr(_text, "PIECE_BYTES", piece)
        row = 0
        for _, data, offsets in _text.chunks(pa.array(texts), 64):
            hashes, first, end, by_row = _text.words(data, offsets, _text.SPACED)
            low = _text.LOWER[data].tobytes()
            for a, b in zip(by_row[:-1], by_row[1:]):
                assert [low[first[i] : end[i]].decode() for i in range(a, b)] == want[row]
                row += 1
            for i, h in enumerate(hashes.tolist()):
                assert seen.setdefault(low[first[i] : end[i]], h) == h
        assert row == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    hashes = _text.words(np.frombuffer(f"{one} {two}".encode(), np.uint8), np.array([0, 2049]), _text.SPACED)[0]
    assert hashes[0] != hashes[1]
    texts = [f"x y {one} z w", f"x y {two} z w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]
    benchmark = spark.createDataFrame([(7, texts[0])], "item_id long, text string")
    found = decontam.find_spans(docs, benchmark).orderBy("doc_id").collect()
    assert [len(r["__fm_spans"]) for r in found] == [1, 0]


def test_hits_are_of_words_and_not_of_hashes(monkeypatch):
    """Where a document's word has the hash of another word of the benchmark, it is no hit; where two of the benchmark have one hash, another is taken."""
    plain = _text.words

    def confused(data, offsets, is_word, salt=0):
        hashes, first, end, by_row = plain(data, offsets, is_word, salt)
        low = _text.LOWER[data].tobytes()
        for i in range(len(hashes)):
            if low[first[i] : end[i]] == b"other" or (salt == 0 and low[first[i] : end[i]] == b"w3"):
                hashes[i] = plain(np.frombuffer(b"w2", np.uint8), np.array([0, 2]), is_word, salt)[0][0]
        return hashes, first, end, by_row

    monkeypatch.setattr(decontam, "words", confused)
    item = " ".join(f"w{i}" for i in range(20))
    phrases = decontam.Phrases([("a", item)])
    assert phrases.salt == 1
    texts = [item, item.replace("w2 ", "other "), item.replace("w2 ", "w3 ")]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    _, _, by_row, start, size, _ = phrases.occurrences(data, offsets)
    got = [sorted(int(s - by_row[r]) for s in start if by_row[r] <= s < by_row[r + 1]) for r in range(3)]
    assert got == [list(range(8)), [3, 4, 5, 6, 7], [3, 4, 5, 6, 7]] and set(size) == {13}


def test_shards_of_one_long_text(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 17)
    rng = random.Random(3)
    item = [f"w{rng.randrange(6)}" for _ in range(30)]
    text = [rng.choice(["w1", "w2", "zz"]) for _ in range(40)] + item + ["zz"] + item[5:25] + ["w0"] * 9
    phrases = decontam.Phrases([("a", " ".join(item)), ("b", "w0 w0")])
    data = np.frombuffer(" ".join(text).encode(), np.uint8)
    _, _, _, start, size, _ = phrases.occurrences(data, np.array([0, len(data)]))
    want = {(i, 13) for i in range(len(text) - 12) for k in range(18) if text[i : i + 13] == item[k : k + 13]} | {(i, 2) for i in range(len(text) - 1) if text[i : i + 2] == ["w0", "w0"]}
    assert set(zip(start.tolist(), size.tolist())) == want


def test_memory_of_a_long_text():
    """20 MB in one text: 400 MB of arrays at most, in whatever operator."""
    rng = random.Random(1)
    some = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 10))) for _ in range(20_000))
    text = (some + ". ") * (20_000_000 // len(some))
    column = pa.array([text])
    filters = langid.Filters.of(["p", "q"], np.full((1, 1 << 16), 3, np.uint64), 0)
    field = toxicity.Field(0.1)
    phrases = decontam.Phrases([("a", some[:400])])
    _, data, offsets = next(_text.chunks(column))
    runs = {
        "words": lambda: _text.words(data, offsets, _text.SPACED),
        "shingles": lambda: list(neardup._shingle_sets(column)),
        "grams": lambda: filters.counts(data, offsets),
        "statistics": lambda: quality.statistics(data, offsets),
        "tags": lambda: list(field.texts(column)),
        "phrases": lambda: phrases.occurrences(data, offsets),
    }
    for name, run in runs.items():
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6, (name, peak)
