"""Large groups of near copies, whose lists are compared in blocks, and the stages of the pipeline."""

import random
from collections import Counter

from shiftscope.llm import neardup

WORDS = [f"w{i}" for i in range(300)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of(texts):
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
    return [find(i) for i in range(len(texts))]


def groups(rng):
    """Near copies of one text, chains in which each differs a little from the one before, and texts with a common passage."""
    texts = []
    base = [rng.choice(WORDS) for _ in range(120)]
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    chain = [rng.choice(WORDS) for _ in range(120)]
    for _ in range(60):
        chain[rng.randrange(len(chain))] = rng.choice(WORDS)
        texts.append(" ".join(chain))
    passage = [rng.choice(WORDS) for _ in range(90)]
    for _ in range(60):
        texts.append(" ".join(passage + [rng.choice(WORDS) for _ in range(45)]))
    rng.shuffle(texts)
    return texts


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_LIST", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = groups(random.Random(8))
    want = components_of(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}
    assert got == dict(enumerate(want))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = " ".join(rng.choice(WORDS) for _ in range(40))
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) + "." for _ in range(120)]
    bad = ["#### |||| $$$ " * rng.randrange(10, 20) + str(k) for k in range(60)]
    texts = [*good, *bad, *good[:10], *(g + " " + item for g in good[20:26])]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 120 <= i < 180), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, kept, str(tmp_path))
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == [i for i in range(len(texts)) if not 120 <= i < 180] and kept.columns == docs.columns
    own = components_of([texts[i] for i in ids])
    kept = stages["neardup"](spark, kept, str(tmp_path))
    left = [i for at, i in enumerate(ids) if own[at] == at]
    assert sorted(r.doc_id for r in kept.collect()) == left and kept.columns == docs.columns
    kept = stages["decontam"](spark, kept, str(tmp_path))
    clean = [i for i in left if item not in texts[i]]
    assert sorted(r.doc_id for r in kept.collect()) == clean and len(clean) < len(left) and kept.columns == docs.columns
    mixed = stages["mixing"](spark, kept, str(tmp_path))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(clean) and max(copies.values()) <= 2 and mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == copies
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(24)) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == k) == list(range(n))
