"""Relations counted by scope, against their cells, and the plan of those of windows."""

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import controlflow, grid

EVENTS = "w long, trace_idx long, event_idx long, activity string"


def logged(spark):
    texts = ["abc", "acb", "a", "ba", "a-b", "-a", "--", "bb", "ca", "c", "-", "aabc", "de"]
    rows = [(w, 100 * w + t, i, None if a == "-" else a) for w in range(4) for t, text in enumerate(texts[w:]) for i, a in enumerate(text)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("direction", ["followed_by", "preceded_by"])
@pytest.mark.parametrize("scope", [[], ["w"]])
def test_relation_counts_are_those_of_the_cells(spark, direction, scope):
    events = logged(spark)
    cells = controlflow.relations(events, direction, scope).collect()
    want = {}
    for r in cells:
        own = want.setdefault((*[r[c] for c in scope], r.a1), {"a": 0, "s": 0, "n": 0})
        own[r.relation] += 1
    found = controlflow.relation_counts(events, direction, scope).collect()
    assert len(found) == len(want)
    assert {(*[r[c] for c in scope], r.activity): {"a": r.always, "s": r.sometimes, "n": r.never} for r in found} == want
    assert any(r.activity is None for r in found) and any(r.always for r in found) and any(r.sometimes for r in found) and any(r.never for r in found)


@pytest.mark.parametrize("feature", ["Relational Entropy", "Relation Type Counts"])
def test_sums_of_windows_are_not_sent_whole(spark, feature):
    texts = ["abc", "acb", "ba", "cab", "a", "bbca"]
    rows = [(t, i, a) for t in range(120) for i, a in enumerate(texts[t % 6])]
    events = spark.createDataFrame(rows, "trace_idx long, event_idx long, activity string")
    samples, _ = controlflow.feature_samples(events, grid.fixed_grid(spark, 120, 20, slide=10), feature, pane=10)
    # the tables of windows are small as files, and not as rows: read by their bytes they would all be broadcast
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
    held = samples.groupBy("k", "side").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(held) == 2 * 9 and {r.n for r in held} == {3}
