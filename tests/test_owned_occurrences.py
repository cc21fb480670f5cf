from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.operators import features as ft

ROWS = [(1, "f", "kmers", "AAAAAABABAB"), (2, "f", "kmers", "AAAA"), (3, "g", "kmers", "ABCABCAB"), (4, None, "kmers", "AAAAA"),
        (1, "f", "domains", "PF1.2\nPF1\nPF2"), (3, "g", "domains", "PF2"), (5, "g", "kmers", None)]


def _contents(spark):
    return spark.createDataFrame(ROWS, "instance_id long, file string, feature_type string, content string")


def test_counts_of_an_owner_are_the_sums_of_its_instances(spark):
    contents = _contents(spark)
    names = ["AAA", "ABA", "BAB", "ABC", "BCA"]
    vocab = spark.createDataFrame([("kmers", n, i) for i, n in enumerate(names)] + [("domains", "PF1", 5), ("domains", "PF2", 6)],
                                  "feature_type string, feature string, idx long")
    key = lambda r: tuple((x is not None, x) for x in r)
    want: dict = {}
    owner = {(i, t): f for i, f, t, _ in ROWS}
    for r in ft.occurrences(contents, vocab, 3).collect():
        at = (owner[r["instance_id"], r["feature_type"]], r["idx"])
        want[at] = want.get(at, 0.0) + r["cnt"]
    got = ft.occurrences(contents, vocab, 3, owner="file").groupBy("instance_id", "idx").agg(F.sum("cnt").alias("cnt")).collect()
    assert sorted((key((r["instance_id"], r["idx"])), r["cnt"]) for r in got) == sorted((key(k), v) for k, v in want.items())
    assert want["f", 0] == 3.0 and want[None, 0] == 1.0


def test_kmers_are_counted_where_their_instance_lies(spark):
    """Contents are dealt by key; the counts need no shuffle of their own."""
    out = ft.kmer_occurrences(_contents(spark), 3, ["instance_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert shuffles and not any("feature" in line for line in shuffles)
