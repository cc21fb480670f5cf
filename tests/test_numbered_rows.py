from __future__ import annotations

from clusterloom.operators import evaluate as ev
from clusterloom.operators.ordered import index_rows


def test_rows_of_one_sequence_are_numbered_where_they_lie(spark):
    """The few numbers that partitions start from are no table that is read, and rows are not shuffled to join them."""
    rows = index_rows(spark.createDataFrame([(i * 37 % 100,) for i in range(100)], "v long").repartition(5), [], ["v"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted((r.pos, r.v) for r in rows.collect()) == [(i, i) for i in range(100)]
    assert index_rows(spark.createDataFrame([], "v long"), [], ["v"]).collect() == []


def test_clusters_known_by_their_start_are_joined_where_they_lie(spark):
    clusters = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "d"]), (2, ["e", "f"])], "pos long, genes array<string>")
    asked = spark.createDataFrame([(5, ["a", "x"]), (6, ["x", "f", "d"]), (7, ["x"])], "pos long, genes array<string>")
    best = ev.best_original(asked, clusters)
    assert sorted((r.pos, r.original_pos) for r in best.collect()) == [(5, 0), (6, 1), (7, None)]
    assert "FileScan" in best._jdf.queryExecution().executedPlan().toString()  # held, so its size is known
