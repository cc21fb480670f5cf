from __future__ import annotations

import numpy as np

from clusterloom.llm import subspace_join as s
from clusterloom.llm.queries import QUERIES


def brute(rows, cosine=0.98):
    n = len(rows)
    good = [v is not None and len(v) > 0 and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    linked = [[False] * n for _ in range(n)]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for g, (_, v, _) in zip(good, rows)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                linked[i][j] = linked[j][i] = True
    out, component = [], list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(n):
                if linked[x][y] and y not in seen:
                    seen.add(y)
                    todo.append(y)
        component[i] = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((repr(rows[i][0]), sum(linked[i]), component[i], rows[i][0] is not None and rows[i][0] == component[i]))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, l, 5) for i, v, l in rows], "vec_id long, embedding array<float>, label int, n_links int")
    return sorted(((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in s.cluster(df, **options).collect()), key=repr)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d in (3, 8, 64):
        for c in range(5):
            base = rng.normal(size=d)
            for _ in range(12):
                noise = rng.normal(size=d) * rng.choice([0.01, 0.1, 0.2]) * np.linalg.norm(base) / np.sqrt(d)
                rows.append((len(rows), ((base + noise) * rng.choice([1, 5])).tolist(), int(c % 2)))
    same = rows[7][1]
    rows += [(900, same, rows[7][2]), (900, same, rows[7][2]), (None, same, rows[7][2]), (901, same, None), (902, None, 1), (903, [], 1), (904, [0.0] * 8, 1),
             (905, [1.0, None, 2.0], 1), (906, [1.0, float("nan"), 2.0], 1), (907, [1.0, float("inf"), 2.0], 1), (-5, same, 9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block_dims=3) == brute(rows)
    assert run(spark, []) == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in QUERIES["op4_subspace_join"](spark, sf_dir).collect()), key=repr)
    assert got == brute(rows)
