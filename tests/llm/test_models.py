"""The learned operators against plain versions: Bloom filters against sets, the discriminant against its covariances, the field against enumeration."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from shiftscope.llm import langid, quality, toxicity
from shiftscope.llm._text import chunks


def grams_of(text):
    """n-grams of bytes, as the module's docstring defines them."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    kept = bytearray(b" ")
    for i, c in enumerate(low):
        letter = 97 <= c <= 122 or c >= 128
        before = i and (97 <= low[i - 1] <= 122 or low[i - 1] >= 128)
        if letter:
            kept.append(c)
        elif before:
            kept.append(32)
    if len(kept) == 1:
        return []
    return [bytes(kept[i : i + n]) for n in langid.SIZES for i in range(len(kept) - n + 1)]


def test_filters_against_sets(spark, monkeypatch):
    rng = random.Random(12)
    words = {"p": ["brota", "chelin", "dravo", "öl"], "q": ["zuxi", "yoqa", "brota", "éh"], "r": ["melk", "dravo", "trud"]}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randrange(1, 9))) + rng.choice(["", ".", " 1!"]), x) for i, x in enumerate(rng.choices("pqr", k=90))] + [(500, None, "p"), (501, "", "q"), (501, "", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = 40
    filters = langid.fit(frame, modulus=1000, held_out=999, grams=kept)
    every = {g for _, t, _ in rows for g in grams_of(t)}
    code = lambda g: (int.from_bytes(g, "big") + (len(g) << 56)) & ((1 << 64) - 1)
    hashed = {g: langid.mix(np.array([code(g)], np.uint64)) for g in every}
    for k, x in enumerate("pqr"):
        count = Counter(g for _, t, y in rows if x == y for g in grams_of(t))
        top = sorted(count, key=lambda g: (-count[g], int(hashed[g].view(np.int64)[0])))[:kept]
        has = {g for g in every if filters.holding(hashed[g])[0, 0] >> np.uint64(k) & np.uint64(1)}
        assert set(top) <= has and len(has) - len(top) <= 3
        bits = np.count_nonzero(filters.table[0] & np.uint64(1 << k))
        assert filters.false_rate[k] == pytest.approx((bits / filters.table.shape[1]) ** langid.HASHES)
    for piece in (5, 1 << 20):
        monkeypatch.setattr(langid, "PIECE_BYTES", piece)
        for chunk in (1, 1 << 20):
            row = 0
            for _, data, offsets in chunks(pa.array([t for _, t, _ in rows]), chunk):
                counts, total = filters.counts(data, offsets)
                for got, n in zip(counts, total, strict=True):
                    own = grams_of(rows[row][1])
                    assert n == len(own)
                    hits = np.array([sum(int(filters.holding(hashed[g])[0, 0] >> np.uint64(k) & np.uint64(1)) for g in own) for k in range(3)], float)
                    assert got == pytest.approx(np.maximum(0, (hits - n * filters.false_rate) / (1 - filters.false_rate)))
                    row += 1
    for r in langid.identify(frame, filters).collect():
        if r.text:
            assert r["__lang_pred"] in "pqr" and 0 < r["__lang_score"] <= 1
        else:
            assert (r["__lang_pred"], r["__lang_score"]) == ("und", 0.0)


def test_one_text_is_enough(spark):
    frame = spark.createDataFrame([(0, "brota chelin", "p"), (1, "zuxi yoqa", "q"), (2, "chelin", None), (6, "yoqa", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r["__lang_pred"] for r in langid.identify(frame, langid.fit(frame, modulus=1000, held_out=999)).collect()}
    assert got[2] == "p" and got[6] == "q"


def test_discriminant_against_covariances(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["One", "two,", "THREE!", "4", "|", "five."]) for _ in range(rng.randrange(1, 60))) + "\n" * rng.randrange(3) for _ in range(200)] + ["", None]
    labels = [(i, int(len(t or "") % 3 > 0), 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(frame, marks, modulus=1000, held_out=999)
    x = np.concatenate([quality.statistics(data, offsets) for _, data, offsets in chunks(pa.array(texts))])
    assert x.shape == (202, quality.D) and np.allclose(np.concatenate([quality.statistics(d, o) for _, d, o in chunks(pa.array(texts), 1)]), x)
    y = np.array([q for _, q, _ in labels])
    centre, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = (x - centre) / scale
    logs = []
    for k in (0, 1):
        cov = np.cov(z[y == k], rowvar=False, bias=True)
        cov = (1 - quality.SHRINK_DIAGONAL) * cov + quality.SHRINK_DIAGONAL * np.diag(np.diag(cov))
        cov = (1 - quality.SHRINK_UNIT) * cov + quality.SHRINK_UNIT * np.eye(quality.D)
        gap = z - z[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    words = np.array([len((t or "").split()) for t in texts])
    evidence = np.clip((logs[1] - logs[0]) / quality.TEMPER, -quality.BOUND, quality.BOUND) * words / (words + quality.FEW)
    want = 1 / (1 + np.exp(-evidence - np.log(y.mean() / (1 - y.mean()))))
    got = [r["__quality_score"] for r in quality.scored(frame, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def enumerated(n, emission, transition, allowed=None):
    """(log sum, P(toxic) by place, expected pairs) over all taggings."""
    weights, toxic, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in product((0, 1), repeat=n):
        if allowed is not None and any(not allowed[i][t] for i, t in enumerate(tags)):
            continue
        w = np.exp(sum(emission[i] for i, t in enumerate(tags) if t) + sum(transition[a, b] for a, b in zip(tags, tags[1:])))
        weights += w
        toxic += w * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            pairs[a, b] += w
    return np.log(weights), toxic / weights, pairs / weights


def test_chain_pass_against_enumeration():
    rng = np.random.default_rng(3)
    n = np.array([1, 4, 7, 7])
    emission, transition = rng.normal(size=(4, 8)), rng.normal(size=(2, 2))
    allowed = np.ones((4, 8, 2))
    allowed[1, 2, 0] = allowed[2, 0, 1] = allowed[3, 6, 0] = 0
    log_sum, toxic, pairs = toxicity.chain_pass(n, allowed, emission, np.exp(transition))
    for i in range(4):
        want = enumerated(n[i], emission[i], transition, allowed[i])
        assert log_sum[i] == pytest.approx(want[0]) and toxic[i, : n[i]] == pytest.approx(want[1]) and pairs[:, :, i] == pytest.approx(want[2])
        assert not toxic[i, n[i] :].any()


def test_marginals_of_whole_texts_against_enumeration():
    rng = np.random.default_rng(4)
    field = toxicity.Field(0.3, weights=np.array([0.0, 0.0, -1.2]), transition=np.array([[0.2, -1.0], [-0.7, 1.1]]))
    n = np.array([9, 3, 0, 1, 11, 5])
    at = [[2, 4, 5, 8], [0], [], [0], [1, 10], []]
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in at])))
    emission = rng.normal(size=bounds[-1])
    got = field.marginals(n, bounds, np.array([x for a in at for x in a], np.int64), emission)
    for i, own in enumerate(at):
        if own:
            every = np.full(n[i], -1.2)
            every[own] = emission[bounds[i] : bounds[i + 1]]
            assert got[bounds[i] : bounds[i + 1]] == pytest.approx(enumerated(n[i], every, field.transition)[1][own])


def test_gradient_against_differences():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(6):
        n = int(rng.integers(1, 9))
        k = int(rng.integers(0, 5))
        rows.append((n, int(rng.integers(1, 4)), rng.integers(-1, 2, n).tolist() if k else [0] * n, rng.integers(0, n, k).tolist(), rng.integers(0, 5, k).tolist()))
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["n", "times", "tags", "place", "number"])

    class Shared:
        pass

    def at(x):
        shared = Shared()
        shared.value = (x[:6], x[6:].reshape(2, 2))
        out = next(toxicity._gradients(shared, 6)(iter([batch])))
        return out.column(0)[0].as_py(), np.array(out.column(1)[0].as_py())

    x = rng.normal(size=10)
    slope = at(x)[1]
    for i in range(10):
        step = np.zeros(10)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((at(x + step)[0] - at(x - step)[0]) / 2e-5, abs=1e-5)


def test_maximum_of_a_smooth_function():
    a = np.array([[3.0, 1.0, 0.0], [1.0, 2.0, 0.3], [0.0, 0.3, 40.0]])
    top = np.array([1.0, -2.0, 0.5])
    found = toxicity.maximised(lambda x: (5 - 0.5 * (x - top) @ a @ (x - top), -a @ (x - top)), np.zeros(3), steps=60)
    assert found == pytest.approx(top, abs=1e-2)


def test_small_toxic_sample_learns(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choices(["ab", "cde", "fgh", "ij", "klmn"], k=20)) for _ in range(30)]
    toxic = [c.replace("ij", "vileword") + " vileword" for c in clean[:9]]
    frame = spark.createDataFrame(list(enumerate([*clean, *toxic, "ab vileword cde", "ab cde"])), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 30)) for i in range(39)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.tagged(frame, toxicity.fit(frame, marks, modulus=1000, held_out=999)).collect()}
    assert got[39]["__tox_score"] > got[40]["__tox_score"]
    assert [(s.start, s.end) for s in got[39]["__tox_spans"]] == [(3, 11)] and got[40]["__tox_spans"] == []
