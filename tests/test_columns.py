from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import learn as ln
from clusterloom.operators import margin as mg


def words(rows=60, seed=5):
    """Few common words, copies of them, and many that stand in one row only; the last ten rows are not trained on."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((rows, 6)) < 0.5, rng.integers(1, 4, (rows, 6)), 0).astype(float)
    label = (x[:, 0] + rng.normal(0, 1.0, rows) > x[:, 1]).astype(int)
    alone = np.zeros((rows, 3 * rows))
    for i in range(rows):
        alone[i, 3 * i:3 * i + 3] = 2
    x = np.hstack([x, x[:, :2], alone])
    x[50:, 6] = x[50:, 0] + 1  # a copy in the training rows that differs in the others
    x[55, 8] = 4
    return x, label


def frames(spark, x, label):
    occ = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "instance_id long, idx int, cnt double")
    return occ, spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)], "instance_id long, label int")


def test_equal_features_are_one_column(spark):
    x, label = words()
    occ, labels = frames(spark, x, label)
    columns, n = ln.equal_columns(occ.filter("instance_id < 50"), 50, "sum")
    rows = columns.collect()
    sets = {}
    for j in range(x.shape[1]):
        if x[:50, j].any():
            sets.setdefault(x[:50, j].tobytes(), set()).add(j)
    got = {}
    for r in rows:
        got.setdefault(r.column, set()).add(r.idx)
        assert abs(r.share * len(sets[x[:50, r.idx].tobytes()]) - 1) < 1e-12
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, sets.values())) and sorted(got) == list(range(n))
    assert n == 56 and x.shape[1] == 188


@pytest.mark.parametrize("kind, penalty", [("logit", "sum"), ("squared hinge", "squares")])
def test_a_fit_on_columns_is_the_fit_on_features(spark, kind, penalty):
    """Scores of trained rows and of others, whose counts of the merged words differ."""
    x, label = words()
    occ, labels = frames(spark, x, label)
    known = F.col("instance_id") < 50
    columns, n = ln.equal_columns(occ.filter(known), 50, penalty)
    scores = []
    for given, width in ((occ, x.shape[1]), (ln.on_columns(occ, columns), n)):
        if kind == "squared hinge":
            rows = ln.sparse_rows(given, labels).join(labels, "instance_id")
            model = mg.fit_squared_hinge(rows.filter(known), width, 0.1, 1e-5)
            scores.append({r.instance_id: r.margin for r in mg.margins(rows, model).collect()})
        else:
            data = ln.labelled(ln.feature_vectors(given, width, labels), labels)
            model = ln.train(data.filter(known), kind, width, maxIter=150, tol=1e-9, C=0.4)
            scores.append({r.instance_id: r.confidence for r in ln.confidence_table(model.transform(data)).collect()})
    whole, merged = (np.array([s[i] for i in range(60)]) for s in scores)
    scale = np.abs(whole).max()
    assert scale > 0.1 and np.allclose(whole, merged, atol=0.02 * scale)


def test_hinge_loss_on_columns_is_that_on_features(spark):
    """The solver does not reach the minimum of this loss, so the loss of the features' weights is compared."""
    x, label = words()
    occ, labels = frames(spark, x, label)
    known = F.col("instance_id") < 50
    columns, n = ln.equal_columns(occ.filter(known), 50, "scaled squares")
    of = {r.idx: (r.column, r.share) for r in columns.collect()}
    sign, spread = 2 * label[:50] - 1, x[:50].std(0, ddof=1)
    losses = []
    for given, width, more in ((occ, x.shape[1], {}), (ln.on_columns(occ, columns), n, {"standardization": False})):
        data = ln.labelled(ln.feature_vectors(given, width, labels), labels)
        model = ln.train(data.filter(known), "linearsvc", width, C=0.4, **more).stages[-1]
        w = model.coefficients.toArray()
        if width == n:
            w = np.array([w[of[j][0]] * of[j][1] if j in of else 0.0 for j in range(x.shape[1])])
        losses.append(np.maximum(0, 1 - sign * (x[:50] @ w + model.intercept)).mean() + ((w * spread) ** 2).sum() / (2 * 0.4 * 50))
    assert losses[1] < 1.3 * losses[0] < 0.02


@pytest.mark.parametrize("kind", ["logit", "linearsvc"])
def test_wide_models_are_fitted_on_columns_few_at_a_time(spark, monkeypatch, kind):
    x, label = words()
    occ, labels = frames(spark, x, label)
    run = lambda: ln.cross_validate(occ, labels, kind, x.shape[1], folds=2)
    plain, _ = run()
    monkeypatch.setattr(ln, "WIDE", 100)
    monkeypatch.setattr(ln, "TOGETHER", 70)
    widths, pools = [], []
    train, pool = ln.train, ln.ThreadPool
    monkeypatch.setattr(ln, "train", lambda data, kind, n, **o: widths.append(n) or train(data, kind, n, **o))
    monkeypatch.setattr(ln, "ThreadPool", lambda n: pools.append(n) or pool(n))
    out, model = run()
    assert max(widths) < 80 and pools == [1] and ln.input_width(model) == x.shape[1]
    rows = lambda df: {r.instance_id: (r.fold, r.label, r.prediction) for r in df.collect()}
    a, b = rows(plain), rows(out)
    assert {i: v[:2] for i, v in a.items()} == {i: v[:2] for i, v in b.items()}
    assert sum(a[i] == b[i] for i in a) >= 57
    assert model.transform(occ, labels).count() == 60
