from __future__ import annotations

import numpy as np

from clusterloom.operators import margin as mg

SCHEMA = "instance_id long, indices array<int>, values array<double>, label double"


def dense_solution(x, y, c):
    """Newton steps on the full matrix with an intercept column."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        active = 1 - y * (x @ w) > 0
        a = x[active]
        # The minimum for a fixed active set is a least-squares problem.
        new = np.linalg.solve(np.eye(len(w)) + 2 * c * a.T @ a, 2 * c * a.T @ y[active])
        if np.allclose(new, w, atol=1e-12):
            return new
        w = w + 0.7 * (new - w) if _ < 50 else new
    return w


def test_weights_match_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((80, 6)) < 0.5, rng.integers(1, 4, (80, 6)), 0).astype(float)
    x[0] = 0
    label = (x[:, 0] + rng.normal(0, 0.7, 80) > x[:, 1]).astype(float)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], float(label[i])) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (99, [0], [5.0], None)], SCHEMA)
    model = mg.fit_squared_hinge(df, 6, 0.1, 1e-6)
    full = np.hstack([x, np.ones((80, 1))])
    want = dense_solution(full, 2 * label - 1, 0.1)
    assert np.allclose(model.weights, want, atol=1e-4)
    got = {r["instance_id"]: r for r in mg.margins(df, model).collect()}
    assert len(got) == 81
    assert np.allclose([got[i]["margin"] for i in range(80)], full @ model.weights)
    assert abs(got[0]["margin"] - model.weights[-1]) < 1e-9
    assert all(got[i]["prediction"] == float(full[i] @ model.weights > 0) for i in range(80))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = mg.fit_squared_hinge(empty, 3)
    assert not model.weights.any() and mg.margins(empty, model).count() == 0
