from __future__ import annotations

import random

from clusterloom.operators import match as mt


def test_votes_take_the_best_of_each_block_first(spark):
    """Genes of several blocks, pairs that come both ways and ties get the votes they get without blocks."""
    rng = random.Random(8)
    rows = [(rng.randint(0, 3), f"g{rng.randint(0, 9)}", f"g{rng.randint(0, 9)}", float(rng.randint(1, 12))) for _ in range(300)]
    pairs = spark.createDataFrame(rows, "block int, a string, b string, pident double").repartition(3, "block")
    genes = spark.createDataFrame([(f"g{i}",) for i in range(0, 12, 2)], "gene string")
    kept = spark.createDataFrame([(f"g{i}",) for i in (1, 2, 3, 5, 8)], "gene string")
    best: dict[tuple, float] = {}
    for _, a, b, p in rows:
        for x in ((a, b), (b, a)):
            best[x] = max(best.get(x, 0.0), p)
    want = {}
    for g in range(0, 12, 2):
        near = sorted((-p, b) for (a, b), p in best.items() if a == f"g{g}")[:3]
        want[f"g{g}"] = round(0.1 * sum(b in ("g1", "g2", "g3", "g5", "g8") for _, b in near), 6)
    votes = lambda within: mt.vote_by_similar(genes, pairs if within else pairs.drop("block"), kept, top=3, within=within)
    got = [{r.gene: round(r.score, 6) for r in votes(w).collect()} for w in ((), ("block",))]
    assert got == [want, want]
    plan = votes(("block",))._jdf.queryExecution().executedPlan().toString()
    assert "partitionBy" not in plan and plan.count("WindowGroupLimit [block") >= 1
