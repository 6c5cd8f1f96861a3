"""Pairs that are joined as rows: they grow with the classes, not with the pairs of a long list."""

import random

import numpy as np

from shiftscope.llm import neardup
from tests.llm.test_long_lists import WORDS, components_of

PASSAGES = 12


def alike(rng, n):
    """Texts of one group that share most of many passages, each of which is changed in some: seldom linked, but often alike."""
    passages = [[rng.choice(WORDS) for _ in range(20)] for _ in range(PASSAGES)]
    texts = []
    for _ in range(n):
        own = set(rng.sample(range(PASSAGES), 2))
        texts.append(" ".join(" ".join(rng.choice(WORDS) for _ in range(20)) if p in own else " ".join(passages[p]) for p in range(PASSAGES)))
    return texts


def test_long_lists_are_not_joined_as_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_LIST", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    joined = []
    crossing = neardup.crossing_pairs

    def counted(here, wide, classes):
        pairs = crossing(here, wide, classes)
        lists = {}
        for r in here.filter(f"members > {neardup.SMALL_LIST}").select("token", "set").collect():
            lists.setdefault(r.set, set()).add(r.token)
        joined.append(sum(bool(lists.get(p.a, set()) & lists.get(p.b, set())) for p in pairs.collect()))
        return pairs

    monkeypatch.setattr(neardup, "crossing_pairs", counted)
    texts = alike(random.Random(3), 120)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}
    assert got == dict(enumerate(components_of(texts)))
    assert joined == [0]


def test_shared_lists(monkeypatch):
    monkeypatch.setattr(neardup, "LISTS", 3)
    rng = np.random.default_rng(5)
    lists = [rng.choice(40, size=k, replace=False).astype(np.int64) for k in (0, 1, 5, 9, 0, 7, 3)]
    left, right = np.array([0, 2, 3, 6]), np.array([1, 4, 5])
    want = [[bool(set(lists[i]) & set(lists[j])) for j in right] for i in left]
    assert neardup._share(lists, left, right).tolist() == want
    assert not neardup._share([np.zeros(0, np.int64)] * 2, np.array([0]), np.array([1])).any()
