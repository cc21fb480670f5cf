from __future__ import annotations

import math
import random

import numpy as np

from clusterloom.llm import hard_negatives as h


def brute(rows, every):
    v = set()
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        v.add((i, label, tuple(math.floor(256 * c) for c in x)))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a in v:
        if a[0] % every:
            continue
        near = sorted(((-dot(a[2], b[2]), b[0]) for b in v if b[1] == a[1] and b[0] != a[0]))[:5]
        for top, positive in near:
            low = sorted((-dot(a[2], b[2]), b[0]) for b in v if b[1] != a[1] and 80 * -top <= 100 * dot(a[2], b[2]) <= 100 * -top)[:5]
            out += [(a[0], positive, r + 1, i, -top, -s) for r, (s, i) in enumerate(low)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, x, g, "k") for i, x, g in rows], "vec_id long, embedding array<float>, label int, anchor string")
    return sorted(tuple(r) for r in h.mine(table, **options).collect())


def vectors(rng, n, dims=6):
    base = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [[float(np.float32(b + rng.gauss(0, 0.3))) for b in base[rng.randrange(5)]] for _ in range(n)]


def test_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, x, rng.choice([0, 0, 0, 1, 9])) for i, x in enumerate(vectors(rng, 240))]
    rows += [(300, [0.0] * 6, 0), (310, [], 1), (320, [1.0, 2.0], 0), (330, rows[3][1], None), (340, None, 1), (350, [float("nan")] * 6, 0),
             (360, [None, 1.0], 0), (370, [float("inf"), 0.0], 0), (None, rows[2][1], 0), rows[0], (0, rows[5][1], 0)]
    rows += [(400 + i, rows[20][1], i % 3) for i in range(30)]
    want = brute(rows, 10)
    assert len(want) > 200
    assert found(spark, rows, every=10) == want
    assert found(spark, rows, every=10, block=16, pack=3) == want
    assert found(spark, rows[:0]) == []


def test_reading_stops_early_and_is_exact():
    rng = np.random.default_rng(8)
    mat = rng.integers(-40, 40, (4000, 3))
    mat[:20] += 300
    lists = h.Lists(np.arange(4000), np.zeros(4000, np.int64), mat)
    anchor = np.array([5, 7, 0])
    best, depth = h.threshold(lists, anchor, np.ones(4000, bool), [(None, None)], 5)
    score = mat @ anchor
    assert depth < 400
    assert best[0][1].tolist() == sorted(range(4000), key=lambda i: (-score[i], i))[:5]
    windows = [(100, 200), (2000, 2400), (10 ** 6, None)]
    best, _ = h.threshold(lists, anchor, np.ones(4000, bool), windows, 5)
    for (least, most), (s, r) in zip(windows, best):
        assert r.tolist() == sorted((i for i in range(4000) if least <= score[i] <= (most or score[i])), key=lambda i: (-score[i], i))[:5]
