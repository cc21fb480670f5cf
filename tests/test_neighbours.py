from __future__ import annotations

import numpy as np
import pytest

from clusterloom.operators import learn as ln


@pytest.mark.parametrize("n", [3, 40, 900])
def test_closest_rows_against_all_distances(monkeypatch, n):
    """Many equal rows, of which those of the least ids are taken, ids that are names and rows on both sides."""
    monkeypatch.setattr(ln, "NEAR_SPAN", 8)
    monkeypatch.setattr(ln, "NEAR_PAIRS", 50)
    rng = np.random.default_rng(n)
    y = rng.integers(-2, 3, (n, 3)).astype(float)
    others = np.array([f"v{i:04d}" for i in rng.permutation(n)], object)
    x, ids = np.vstack([y[::2], rng.normal(size=(5, 3))]), np.append(others[::2], [f"w{i}" for i in range(5)])
    row, near, distance = ln.closest(x, y, ids, others, 4)
    want = []
    for i in range(len(x)):
        d = np.sqrt(((x[i] - y) ** 2).sum(1))
        want += [(i, others[j], d[j]) for j in sorted((j for j in range(n) if others[j] != ids[i]), key=lambda j: (d[j], others[j]))[:4]]
    assert list(zip(row.tolist(), others[near], distance)) == want


def test_few_distances_are_measured_and_sorted(monkeypatch):
    """Sorting the distances to all rows took most of the time."""
    rng = np.random.default_rng(1)
    y, sizes = rng.normal(size=(4096, 8)), []
    sort = np.lexsort
    monkeypatch.setattr(ln.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    ln.closest(y[:512], y, np.arange(512), np.arange(4096), 20)
    assert 0 < sum(sizes) < 512 * 4096 / 20
