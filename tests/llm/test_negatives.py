import math
import random

import numpy as np
import pytest

from signalbox.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, q string, block int, anchor_id long"


def brute(rows, every=50, positives=5, negs=3, low=50, high=95):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [max(-(2**31 - 1), min(2**31 - 1, math.floor(256 * x))) for x in v]
        key = (label, q[0] if q else 0)
        if i not in known or key < known[i][0]:
            known[i] = (key, label, q)
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = set()
    for a, (_, own, q) in known.items():
        if a % every:
            continue
        scored = [(-cut(sum(x * y for x, y in zip(q, r))), i, label) for i, (_, label, r) in known.items() if i != a]
        for p, i, _ in sorted(s for s in scored if s[2] == own)[:positives]:
            hard = sorted(s for s in scored if s[2] != own and low * -p <= 100 * -s[0] <= high * -p)[:negs]
            out |= {(a, i, n, j, -p, -s) for n, (s, j, _) in enumerate(hard, 1)}
    return out


def vectors(seed):
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        c = rnd.choice(centre)
        rows.append((i if rnd.random() < 0.9 else i - 200, [x + rnd.gauss(0, 0.4) for x in c], rnd.randrange(4)))
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(150)]  # one vector, many ids: ties
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2050, [float("nan")] * 6, 1), (2100, [float("inf")] + [0.0] * 5, 2), (2150, [1.0] * 6, None)]
    rows += [(None, [1.0] * 6, 1), (2200, [], 1), (2250, [0.0] * 6, 1), (2300, [1.0, 2.0], 2), (2301, [-1.0] * 6, 2), (-50, [0.3] * 6, 2)]
    return rows + [(3000, [0.7] * 6, 1)] * 5 + [(50, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("seed,block,anchors", [(1, 8192, 1024), (2, 60, 3)])
def test_against_brute_force(spark, seed, block, anchors, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS).repartition(4)
    got = [tuple(r) for r in negatives.hard_negatives(df, "vec_id % 50 = 0").collect()]
    assert len(got) == len(set(got)) > 100
    assert set(got) == brute(rows)


def test_huge_components_are_exact(spark):
    rows = [(50 * i, [1e300 if i % 2 else 3.0e6 + i, -2.0e6 + i / 256, 1e6, 1e5], i % 2) for i in range(12)]
    rows += [(1 + i, [1.1e6 + i / 256, -1.9e6, 9e5 + i / 256, 7.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in negatives.hard_negatives(df, "vec_id % 50 = 0").collect()}
    assert got == brute(rows) and got


def test_other_limits_and_shifted_labels(spark):
    rows = vectors(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in negatives.hard_negatives(negatives.shifted_labels(df), "vec_id % 20 = 0", 2, 4, 10, 80).collect()}
    moved = [(i, v, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in rows]
    assert got == brute(moved, 20, 2, 4, 10, 80)


def test_boxes_hold_scores_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.integers(-200, 200, (16, 3))
    x = (centres[np.arange(4000) % 16] + rng.integers(-5, 6, (4000, 3))).astype(float)
    ids, labels = np.arange(4000), np.arange(4000) % 3
    tree = negatives.RTree(x, ids, labels, leaf=32, fan=4)
    assert sorted(tree.ids.tolist()) == ids.tolist()
    opened = []
    for a in range(0, 4000, 37):
        q = x[a]
        for level, (low, _) in enumerate(tree.boxes):
            down, up = tree.interval(level, 0, len(low), q)
            span = 32 * 4**level
            for i in range(len(low)):
                s = tree.x[i * span : (i + 1) * span] @ q
                assert down[i] <= s.min() and s.max() <= up[i]
        windows = [(-(10**9), 10**9), (0, 500)]
        best, n = tree.search(q, windows, 3, lambda _, found: found != a % 3)  # noqa: B023
        scored = [(-int(s), i) for i, s in enumerate(x @ q) if i % 3 != a % 3]
        want = [[(-s, i) for s, i in sorted(t for t in scored if lo <= -t[0] <= hi)[:3]] for lo, hi in windows]
        assert best == want
        opened.append(n)
    assert np.mean(opened) < 0.5 * len(tree.boxes[0][0])


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty, "vec_id % 50 = 0").count() == 0
    alone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], empty.schema)
    assert negatives.hard_negatives(alone, "vec_id % 50 = 0").count() == 0
