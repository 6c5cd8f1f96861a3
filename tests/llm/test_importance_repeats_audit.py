"""Importance resampling, repeats and the filter audit against plain models, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftscope.llm import audit, importance, repeats
from shiftscope.llm._text import ALNUM, word_bounds

DOCS = "doc_id long, text string, source string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def model_scores(docs, target):
    def grams(text):
        w = WORDS.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own, aim = Counter(), Counter()
    for _, text, *_ in docs:
        own.update(grams(text)[1])
    for text in target:
        aim.update(grams(text)[1])
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + 10000.0) / ((own[b] + 1.0) * (t_all + 10000.0))))
    out = []
    for doc_id, text, *_ in docs:
        n, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def some_docs(rng, n=300):
    vocabulary = ["alpha", "Beta", "ÉTÉ", "naïve", "x9", "日本", "of", "a" * 70, "b" * 200] + [f"w{i}" for i in range(300)]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 90))), f"s{i % 3}") for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", "s0"), (None, rows[5][1], None), (7, rows[7][1], "s1"), (7, rows[7][1], "s1")]


def test_registers_are_those_of_zlib():
    rng = random.Random(5)
    words = ["".join(rng.choices("abc é日", k=rng.randrange(1, 200))).replace(" ", "") or "q" for _ in range(400)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    first, end = word_bounds(data, np.array([0, len(data)]), ALNUM)
    made = importance.word_registers(data, first, end)
    spans = [data[a:b].tobytes() for a, b in zip(first, end, strict=True)]
    assert [int(x) for x in made] == [zlib.crc32(s, 0xFFFFFFFF) ^ 0xFFFFFFFF for s in spans]
    ones = np.full(len(first), 0xFFFFFFFF, np.uint32)
    assert [int(x) ^ 0xFFFFFFFF for x in importance._moved(ones, end - first) ^ made] == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_importance_against_a_model(spark, monkeypatch, block):
    monkeypatch.setattr(importance, "WORDS", block)
    monkeypatch.setattr(importance, "SORTED_ROWS", 40)
    rows, target = some_docs(random.Random(1)), ["alpha beta w1 w2 w3 w4", None, "", "w5 w6 alpha"]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    # blocks are a matter of the tasks' own module, so the small one is tried on the driver
    if block == 7:
        import pyarrow as pa

        column = pa.array([t for _, t, _ in rows])
        counted = Counter()
        for _, _, _, buckets in importance.features(column):
            counted.update(buckets.tolist())
        monkeypatch.undo()
        assert counted == Counter({b: int(c) for b, c in enumerate(importance.bucket_counts(docs)) if c})
        return
    got = sorted(importance.importance(docs, aims).collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(model_scores(rows, target), key=repr)
    drawn = Counter(r.doc_id for r in got if r["rank"])
    assert Counter(r.doc_id for r in importance.resample(docs, aims).collect()) == drawn


def test_importance_of_nothing_and_clashing_names(spark):
    none, aims = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.importance(none, aims).collect() == []
    assert importance.resample(none, aims).collect() == []
    rows = [(i, "one two three " * 10, "s") for i in range(40)]
    odd = spark.createDataFrame(rows, DOCS).select("*", F.lit("x").alias("__imp_score"), F.lit("y").alias("id"), F.lit("z").alias("rank"))
    drawn = importance.resample(odd, aims)
    assert drawn.columns == odd.columns and drawn.count() == 2
    assert {r["__imp_score"] for r in drawn.collect()} == {"x"}


def model_kept(texts):
    words = [SPACED.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeated_texts(rng):
    vocabulary = [f"w{i}" for i in range(60)] + ["W1", " ", "日本", "x y"]
    some = lambda a, b: rng.choices(vocabulary, k=rng.randrange(a, b))
    passages = [some(30, 140) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += rng.choice([some(0, 60), p, p[a:], p[:a], p[a : a + 36], p[a : a + 35]])
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    # self-overlaps, copies of copies, edges
    return texts + ["ab " * 35, "ab " * 36, "cd " * 34, "x y " * 60, None, "", " \n ", texts[0], texts[0], " " + texts[1], texts[2] + "  "]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_a_model(spark, seed):
    texts = repeated_texts(random.Random(seed))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r["__rep_words"], r["__rep_removed"], r["__rep_kept"]) for r in repeats.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == model_kept(texts)


def test_repeats_across_many_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 400)
    texts = repeated_texts(random.Random(3))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r["__rep_words"], r["__rep_removed"], r["__rep_kept"]) for r in repeats.remove_repeats(docs, with_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == [(n, m, hashlib.sha256(k.encode()).hexdigest()) for n, m, k in model_kept(texts)]


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(4)
    sizes = [0, 3, 34, 35, 36, 400, 0, 90]
    by_row = np.concatenate(([0], np.cumsum(sizes)))
    hashes = rng.integers(0, 40, by_row[-1], dtype=np.uint64)
    row, first, n, _, _ = repeats.segments(hashes, by_row)
    windows = Counter((int(r), int(f) + k - int(by_row[r])) for r, f, m in zip(row, first, n, strict=True) for k in range(m))
    assert windows == Counter((r, k) for r, s in enumerate(sizes) for k in range(s - 34))
    assert n.max() <= repeats.RUNS


def test_repeats_keep_columns_and_take_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b " * 30, "s"), (1, "a b " * 30, None), (1, "c", "t")]
    odd = spark.createDataFrame(rows, DOCS).select("*", F.lit("k").alias("key"), F.lit(1).alias("__rep_words0"), F.lit("u").alias("unique"), F.lit(2).alias("shard"))
    out = repeats.remove_repeats(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert Counter((r.doc_id, r.text, r.source, r.key, r["__rep_removed"]) for r in out.collect()) == Counter([(None, "a b " * 30, "s", "k", 60), (1, "a b " * 30, None, "k", 60), (1, "c", "t", "k", 0)])


def model_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        w = SPACED.findall(text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows),
        }
        docs.append((source or "", {k for k, v in fails.items() if v}, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            before = []
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(gone), sum(f in d[1] for d in before), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shares[part, f] += len(gone)
                before += gone
    return {(p, o, s, *v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.mark.parametrize("hot", [1_000, 4])
def test_audit_against_a_replay(spark, monkeypatch, hot):
    monkeypatch.setattr(audit, "HOT_TEXTS", hot)
    rng = random.Random(9)
    pieces = ["word"] * 3 + [f"w{i}" for i in range(80)] + ["ABC", "#1", "50%", " ", "É"]
    texts = [" ".join(rng.choices(pieces, k=rng.choice([3, 20, 49, 50, 51, 90]))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(i, texts[0], "a") for i in range(120, 200)] + [(None, texts[0], "b"), (None, None, "c"), (400, None, ""), (401, "", "c"), (5, rows[5][1], rows[5][2])]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(3, None, None), (None, 1, 1)]
    got = audit.audit(spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == model_audit(rows, labels)
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
