"""The adaptive walk over a log that comes in runs, and pairs that end at the same trace."""

import random

from shiftscope.operators import adaptive
from tests.test_windows_and_detectors import expected, found, log_of, model


def test_walk_over_runs_is_read_once(spark, monkeypatch):
    monkeypatch.setattr(adaptive, "RUN", 64)
    rng = random.Random(9)
    values = [f"v{rng.randrange(2 + (i // 150) % 3 * 4)}" if i % 11 else None for i in range(1_500)]
    counts = adaptive.adaptive_counts(log_of(spark, values), 12, 3)
    assert found(counts) == expected(model(values, 12, 3, 12, 2))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    # places are given by the walk itself: no series passes through one window, and no walk runs twice
    assert "Window" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


def test_ends_are_held_until_no_pair_can_end_there():
    pairs = [(0, 0, 30, "a"), (1, 0, 40, "b"), (2, 0, 30, "c"), (3, 0, 50, "d")]
    assert sorted(adaptive._distinct_ends(iter(pairs), True, 2, 10, 5)) == [(0, 0, 30, "c"), (1, 0, 40, "b"), (2, 0, 50, "d")]
    many = [(k, 0, 20 + 5 * k, k) for k in range(5_000)]
    assert list(adaptive._distinct_ends(iter(many), True, 2, 10, 5)) == many
