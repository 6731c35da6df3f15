"""Hard negatives against brute force: ties, repeated ids, copies, odd rows and numbers of any size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, positives=5, negatives=10, scale=256):
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(scale * x) for x in v], label))
    out = []
    for n, (i, v, label) in enumerate(whole):
        if i % every:
            continue
        score = lambda w: max(-H.MOST, min(H.MOST, sum(a * b for a, b in zip(v, w))))
        others = sorted((-score(w), j, k) for m, (j, w, k) in enumerate(whole) if m != n)
        for s, j, _ in [x for x in others if x[2] == label][:positives]:
            inside = [(-t, k) for t, k, other in others if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("score", "rank", "anchor", "number"):
        df = df.withColumn(clash, F.lit("x"))
    return sorted(tuple(r) for r in H.mine(df.repartition(5), **more).collect())


def test_mining_equals_brute_force(spark):
    r = random.Random(1)
    # few distinct numbers: many ties, within windows and at their ends
    rows = [(i, [r.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(6)], i % 3) for i in range(700)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


@pytest.mark.parametrize("digit", [1, 3])
def test_windows_are_refined_digit_by_digit(spark, monkeypatch, digit):
    monkeypatch.setattr(H, "DIGIT", digit)
    monkeypatch.setattr(H, "SLACK", 1)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 2) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_groups_of_copies(spark):
    """A third of all rows are one vector, more are anchors and positives of each other."""
    rows = [(i, [1.0, 0.5, 0.25], i % 4) for i in range(0, 400)] + [(1000 + i, [0.5 + i % 7 / 10, 0.5, 0.0], i % 4) for i in range(500)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (100, [1.0], 2), (200, [], 1), (300, None, 1), (400, [1.0, None], 1), (500, [float("nan")], 1), (None, [1.0], 1), (600, [1.0, 1.0], None), (3, [0.9, 1.0], 1), (4, [0.5, 0.5], 2), (5, [0.5, 0.5], 2), (5, [0.5, 0.5], 3), (6, [-1.0, -1.0], 1), (700, [0.0, 0.0], 9), (7, [0.0, 0.0], 9), (8, [1e17, 1e17], 1), (9, [4e16, 4e16], 5), (800, [1e6, 1e6], 5)]
    want = brute(rows)
    assert {w[0] for w in want} >= {0, 200, 700} and mined(spark, rows) == want
    assert mined(spark, []) == []
    assert mined(spark, rows[:2]) == []


def test_few_rows_leave_a_round():
    """Only counts up to the k-th score's bucket are kept, however many rows a task sees."""
    import numpy as np

    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(4000, 8)) * 50)
    window = {"at": 0, "same": False, "low": -(10**6), "high": 10**6, "shift": 8, "need": 10}
    group = H._Group([(10**9 + a, 1, "<f8", 8, x[a].tobytes(), [window]) for a in range(50)])
    counts = H._Counts(group)
    for at in range(0, 4000, 500):
        counts.add(at, np.arange(at, at + 500), np.zeros(500, np.int64), x[at : at + 500])
    assert len(counts.n) <= 50 * 10
    score = (x[:50] @ x.T).astype(int)
    for a in range(50):
        bucket = (10**6 - score[a]) >> 8
        kth = np.sort(bucket)[9]
        mine = counts.window == a
        assert dict(zip(counts.bucket[mine].tolist(), counts.n[mine].tolist())) == {int(b): int((bucket == b).sum()) for b in np.unique(bucket[bucket <= kth])}
