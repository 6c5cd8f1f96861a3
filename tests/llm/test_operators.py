"""Operators that SQL cannot express, against brute force, round trips and held-out accuracy; and the odd cases of all."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from shiftscope.llm import ann, chat, decontam, langid, neardup, quality, secrets, toxicity

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, texts, start=0):
    """Rows with columns whose names other frames have too."""
    rows = [(start + i, t, "a" if i % 3 else None, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, label int, token string")


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(30)]
    texts = [None, "", "one two", "One  two", *base]
    for t in base[:12]:
        w = t.split()
        for changes in (0, 1, 2, 5):
            for _ in range(changes):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += ["same copy of five words here"] * 40

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    frame = docs(spark, texts)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()}
    assert found == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if find(i) == i}
    assert neardup.near_duplicates(docs(spark, [])).collect() == []


def test_deduplication_decides_by_row(spark):
    rng = random.Random(41)
    one, two, three, four, five = (prose(rng, 40) for _ in range(5))
    rows = [(1, one), (None, one), (None, two), (None, None), (2, three), (5, three), (5, four), (None, five), (None, five), (7, ""), (7, one)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, one), (None, two), (None, None), (2, three), (5, four), (None, five), (None, five), (7, "")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted((tuple(r) for r in neardup.deduplicate(frame).collect()), key=key) == sorted(want, key=key)


def test_decontamination_against_windows(spark):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (40, 13, 25, 4)] + ["", None]
    texts = [None, "", items[3], items[0].upper(), *[prose(rng, 80) for _ in range(20)]]
    for k in range(12):
        w = rng.choice(items[:4]).split()
        a = rng.randrange(max(1, len(w) - 14))
        texts.append(prose(rng, rng.randrange(5, 400)) + " -- " + " ".join(w[a : a + rng.randrange(10, 20)]) + "; " + prose(rng, 30))
    texts.append(items[1] + " " + items[1])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    benchmark = spark.createDataFrame([(i, t, "e") for i, t in enumerate(items)], "item_id long, text string, token string")
    frame = docs(spark, texts)
    for block_words in (decontam.BLOCK_WORDS, 20):
        found = decontam.find_spans(frame, benchmark, block_words=block_words)
        got = {r.doc_id: r for r in found.select("doc_id", *[c.alias(n) for n, c in decontam.hits().items()], "__fm_items").collect()}
        for i, t in enumerate(texts):
            w, hit, ids = split(t), set(), set()
            for k, item in enumerate(items):
                x = split(item)
                size = min(13, len(x))
                for p in range(len(x) - size + 1 if size else 0):
                    for at in range(len(w) - size + 1):
                        if w[at : at + size] == x[p : p + size]:
                            hit |= set(range(at, at + size))
                            ids.add(str(k))
            assert (got[i].n_words, got[i].n_hit, got[i]["__fm_items"]) == (len(w), len(hit), sorted(ids))
            assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontam.decontaminate(frame, benchmark.limit(0)).count() == len(texts)
    assert decontam.excise(frame, benchmark).columns == frame.columns


def test_secrets(spark):
    texts = [None, "", 'Password = "abc12345" x', "é AKIA" + "A" * 16, "f" * 24 + " " + "f" * 23, "token: ab", "login: jane\nhost: db.example.org\nkey9 Zx81Qm40Lp77Vb92Nc15Kd\n\nlogin: bob", "Zx81Qm40Lp77Vb92Nc15Kd"]
    frame = docs(spark, texts)
    found = secrets.scan(frame)
    assert found.columns == [*frame.columns, "__secret_spans"]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r["__secret_spans"]] for r in found.collect()}
    assert spans[0] == spans[1] == spans[5] == spans[7] == []
    assert spans[2] == [("assign", 0, 20)] and spans[3] == [("access", 2, 22)] and spans[4] == [("hex", 0, 24)]
    # the parts of the first scope link; the identifier of the second has no complement
    assert [k for k, _, _ in spans[6]] == ["identifier", "endpoint", "opaque"]


def test_secrets_after_many_strong_spans():
    filler = "".join(f"{i:024x}\n" for i in range(70))
    for tail in ("login: jane AKIA" + "B7" * 8, "login: jane " + "0a" * 16):
        strong = secrets.strong_spans(filler + "\n" + tail)
        found = secrets.linked_spans(filler + "\n" + tail, strong)
        alone = secrets.linked_spans(tail, secrets.strong_spans(tail))
        assert len(strong) == 71 and [(k, a - len(filler) - 1, b - len(filler) - 1) for k, a, b in found] == alone
        assert "opaque" not in [k for k, _, _ in found]


def test_secrets_behind_equals_signs():
    value = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLE1K"
    access = "AWS_ACCESS_KEY_ID=AKIA" + "B7" * 8
    for text in (f"{access}\nAWS_SECRET_ACCESS_KEY={value}\n", f"SECRET_KEY={value}\nhost=db.example.org", f"https://x.example.org;AccountKey={value}==;Pool=5"):
        found = secrets.linked_spans(text, secrets.strong_spans(text))
        own = [text[a:b].rstrip("=") for k, a, b in found if k == "opaque"]
        assert own == [value], text
    text = "login=Zx81Qm40Lp77Vb92Nc15Kd"
    assert secrets.linked_spans(text, secrets.strong_spans(text)) == []


def test_secrets_reach_from_end_to_start():
    token = "token: " + "q7" * 300
    for text, kinds in (
        (f"{token}\nlogin: jane\nhttps://x.example.org", ["identifier", "endpoint"]),
        (f"{token}{' ' * 299}\nlogin: jane", ["identifier"]),
        (f"{token}{' ' * 300}\nlogin: jane", []),
        (f"{token}\n\nlogin: jane", []),
        (f"login: jane\n\n{token}", []),
    ):
        assert [k for k, _, _ in secrets.linked_spans(text, secrets.strong_spans(text))] == kinds


def test_secrets_reach_against_all_pairs():
    rng = np.random.default_rng(17)
    for _ in range(300):
        def drawn(n):
            starts = np.sort(rng.integers(0, 6000, n))
            scopes = starts // 2000
            ends = np.minimum(starts + rng.integers(1, 900, n), (scopes + 1) * 2000)
            return starts, ends, scopes

        own, of = drawn(rng.integers(0, 8)), drawn(rng.integers(0, 8))
        order = np.lexsort((of[1], of[0]))
        of = tuple(x[order] for x in of)
        want = [any(c == z and (b <= p <= b + secrets.REACH or a >= q >= a - secrets.REACH) for p, q, z in zip(*of, strict=True)) for a, b, c in zip(*own, strict=True)]
        assert secrets._near(own, of).tolist() == want


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "\\", "\\</s>", "a\\", " x ", "<<", "plain", "\\\\[INST]", "é\n</s"]
    rows = [(c, t, r, x) for c, r in enumerate(("user", "assistant", "system", "<<odd>> ", "")) for t, x in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.segments(turns)).collect()}
    for c in range(5):
        own = [(r, x or "") for k, _, r, x in rows if k == c]
        masked = "".join(x for r, x in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(said), len(masked))
        assert got[c].loss_sha256 == hashlib.sha256(masked.encode()).hexdigest()
    assert chat.digests(chat.segments(turns.limit(0))).collect() == []


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1200, 24)).astype(np.float32)
    vectors[7] = vectors[5]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(2000, None, "x"), (2050, [0.0] * 24, "x"), (2100, [float("nan")] * 24, "x"), (2150, [], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    for block in (4096, 10):
        found = ann.search(frame, F.col("id") % 50 == 0, 5, query_block=block).collect()
        unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
        hits = 0
        for q in range(0, 1200, 50):
            own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
            exact = unit @ unit[q]
            exact[q] = -2
            best = np.lexsort((np.arange(1200), -exact))[:5]
            assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
            assert np.allclose([r.score for r in own], exact[[r.vec_id for r in own]])
            hits += len({r.vec_id for r in own} & set(best.tolist()))
        assert hits >= 0.9 * 5 * 24 and len(found) == 5 * 24
    assert ann.search(frame.limit(0), F.col("id") % 50 == 0, 5).collect() == []


def test_language_held_out(spark):
    rng = random.Random(6)
    languages = {"p": ["brota", "chelin", "dravo", "melk"], "q": ["zuxi", "yoqa", "wexu", "qizo"], "r": ["ärnö", "ølky", "trüd", "knåp"]}
    rows = [(i, prose(rng, 30, languages[x]), x) for i, x in enumerate(rng.choices("pqr", k=300))] + [(900, None, "p"), (901, "", None), (902, "12 34 --", "q"), (903, "zuxi yoqa", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame, langid.fit(frame)).collect()}
    assert all(got[i]["__lang_pred"] == x for i, _, x in rows[:300])
    assert [got[i]["__lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "q"]
    assert all(0 <= r["__lang_score"] <= 1 for r in got.values())
    assert {r["__lang_pred"] for r in langid.identify(frame, langid.fit(frame.limit(0))).collect()} == {"und"}


def test_classifiers_held_out(spark):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.4
        text = prose(rng, rng.randrange(40, 90)) + "."
        if bad:
            text = " ".join(rng.choice(["vileword", "hatefulone", "nastyterm"]) if rng.random() < 0.2 else w for w in text.split()) + " !!! |||| ####" * 4
        texts.append(text)
        labels.append((i, int(not bad), int(bad)))
    frame = docs(spark, [*texts, None, ""])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.scored(frame, quality.fit(frame, marks))
    assert scored.columns == [*frame.columns, "__quality_score"]
    got = [r["__quality_score"] for r in scored.orderBy("doc_id").collect()]
    assert np.mean([(s >= 0.5) == bool(q) for s, (_, q, _) in zip(got, labels)]) > 0.95 and all(0 <= s <= 1 for s in got)
    tagged = toxicity.tagged(frame, toxicity.fit(frame, marks)).orderBy("doc_id").collect()
    assert np.mean([(r["__tox_score"] >= 0.3) == bool(t) for r, (_, _, t) in zip(tagged, labels)]) > 0.95
    toxic = next(i for i, (_, _, t) in enumerate(labels) if t)
    assert tagged[toxic]["__tox_spans"] and tagged[400]["__tox_spans"] == tagged[401]["__tox_spans"] == []
    none = marks.limit(0)
    assert {r["__quality_score"] for r in quality.scored(frame, quality.fit(frame, none)).collect()} == {0.5}
    assert {r["__tox_score"] for r in toxicity.tagged(frame, toxicity.fit(frame, none)).collect()} == {0.0}
    assert quality.scored(frame.limit(0), quality.fit(frame, marks)).collect() == []
