from __future__ import annotations

import threading

from clusterloom.operators import learn as ln


def test_cross_validation_fits_its_models_side_by_side(spark, monkeypatch):
    """All models of three folds and the refit are under way at once, and give what one after the other gives."""
    occ = spark.createDataFrame([(i, i % 2, 1.0 + i % 3) for i in range(60)] + [(i, 2, 1.0) for i in range(60)], "instance_id long, idx long, cnt double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "instance_id long, label int")
    rows = lambda parallelism: sorted(map(tuple, ln.cross_validate(occ, labels, "logit", 3, folds=3, parallelism=parallelism)[0].collect()))
    alone = rows(1)
    assert len(alone) == 60 and {r[1] for r in alone} == {0, 1, 2}
    together = threading.Barrier(4)
    train = ln.train

    def met(*args, **options):
        together.wait(timeout=60)
        return train(*args, **options)

    monkeypatch.setattr(ln, "train", met)
    assert rows(4) == alone


def test_neighbours_are_sent_in_their_own_type(spark):
    """Blocks of any size give equal neighbours, and rows are shuffled as the floats they are."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)).astype(np.float32)
    data = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<float>")
    one, many = (ln.nearest_neighbours(data, "id", "x", k=4, block=b) for b in (1000, 20))
    rows = lambda df: sorted((r["id"], r["other"], round(r["distance"], 9)) for r in df.collect())
    assert rows(one) == rows(many)
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(i, int(j)) for i in range(90) for j in np.argsort(d[i])[:4]} == {(i, j) for i, j, _ in rows(one)}
    assert "array<double>" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_fourier_weights_are_made_once_a_block(spark, monkeypatch):
    """Rows of different features, an empty one and more features than a block give what the hashed normals give."""
    import math

    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(ln, "KERNEL_ROWS", 3)
    monkeypatch.setattr(ln, "KERNEL_COLUMNS", 2)
    rows = [(i, sorted({i % 4, (i * 3) % 7, 5}), None) for i in range(11)] + [(11, [], None)]
    rows = [(i, idx, [0.5 * j - i for j in range(len(idx))]) for i, idx, _ in rows]
    df = spark.createDataFrame(rows, "instance_id long, indices array<int>, values array<double>").repartition(2)
    out = ln.fourier_features(df, 0.4, 6, seed=9)
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    unit = lambda *parts: (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    grid = spark.range(7).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("j"))
    drawn = {(r["i"], r["j"]): (r["u"], r["v"], r["w"]) for r in grid.select(
        "i", "j", unit("i", "j", F.lit(9)).alias("u"), unit("i", "j", F.lit(10)).alias("v"), unit("j", F.lit(11)).alias("w")).collect()}
    normal = lambda i, j: math.sqrt(-2 * math.log(drawn[i, j][0])) * math.cos(2 * math.pi * drawn[i, j][1]) * math.sqrt(0.8)
    got = {r["instance_id"]: r["features"].toArray() for r in out.collect()}
    for i, idx, values in rows:
        want = [math.sqrt(2 / 6) * math.cos(sum(v * normal(x, j) for x, v in zip(idx, values)) + 2 * math.pi * drawn[0, j][2]) for j in range(1, 7)]
        assert np.allclose(got[i], want)


def test_searched_rows_lie_in_partitions_by_their_number(spark, monkeypatch):
    """However few partitions they come in, and all of them once."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(ln, "SEARCH_ROWS", 10)
    data = spark.createDataFrame([(i, Vectors.dense([float(i % 2), float(i % 5)]), float(i % 2)) for i in range(60)], ["instance_id", "features", "label"])
    seen = []
    fit = ln.CrossValidator.fit

    def watched(self, searched, *args):
        seen.append((searched.rdd.getNumPartitions(), searched.count(), searched.select("instance_id").distinct().count()))
        return fit(self, searched, *args)

    monkeypatch.setattr(ln.CrossValidator, "fit", watched)
    _, scores = ln.grid_search(data.coalesce(1), "logit", 2, folds=2, limits={"C": (1,), "penalty": (0.0,)})
    assert seen == [(6, 60, 60)] and scores.first()["mean"] > 0.9


def test_few_sums_a_step_reach_the_driver(spark, monkeypatch):
    """Whatever the number of partitions, of which few are given up."""
    from pyspark.ml.linalg import Vectors

    for n in (*range(1, 300), 1000):
        partitions, depth = ln.aggregation(n)
        assert ln.sums_left(partitions, depth) <= 2 and (partitions == 28 if n <= 28 else 0.58 * n <= partitions <= n)
    assert ln.sums_left(*ln.aggregation(3)) == 1
    data = spark.createDataFrame([(Vectors.dense([float(i % 2)]), float(i % 2)) for i in range(40)], ["features", "label"]).repartition(3)
    seen = []
    made, fit = ln.classifier, ln.Pipeline.fit
    monkeypatch.setattr(ln, "classifier", lambda *a, **o: seen.append(o.get("aggregationDepth")) or made(*a, **o))
    monkeypatch.setattr(ln.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    ln.train(data, "logit", 1)
    monkeypatch.setattr(ln, "WIDE", 1)
    ln.train(data, "logit", 1)
    assert seen == [None, 3, 3, 28]
