from __future__ import annotations

import random

from pyspark.sql import functions as F

from clusterloom.bindings.evaluation import similar_pairs
from clusterloom.operators import evaluate as ev
from clusterloom.operators import match as mt
from clusterloom.operators import similarity as sim

PRED = [
    (0, ["g_00001", "g_00002", "g_00003"], 0.9), (1, ["g_00003", "g_00004"], 0.2),
    (2, ["g_00004", "g_00006", "g_00007"], 0.5), (3, ["g_00020"], 0.1),
]
GOLD = [("A", f"g_0000{i}") for i in (1, 2, 3, 4, 6)] + [("B", "g_00020"), ("B", "g_00021"), ("C", "g_00001"), ("A", "g_00001")]


def frames(spark):
    return (spark.createDataFrame(GOLD, "cluster_id string, gene string"),
            spark.createDataFrame(PRED, "pos long, genes array<string>, score double"))


def test_matches_and_scores(spark):
    gold, pred = frames(spark)
    matched = ev.match_gold(gold, pred)
    rows = {(r["cluster_id"], r["gene"]): (r["label"], r["predicted_cluster"]) for r in matched.collect()}
    assert rows[("A", "g_00004")] == (1, "Clusterg_00003_g_00004")  # negative first, positive later
    assert rows[("B", "g_00020")] == (0, "Clusterg_00020_g_00020")
    assert rows[("B", "g_00021")] == (0, "not found")
    scores = {r["cluster_id"]: (r["run"], r["n_genes"]) for r in ev.cluster_scores(matched).collect()}
    assert scores == {"A": (3, 5), "B": (0, 2), "C": (1, 1)}
    best = {r["cluster_id"]: r["predicted_cluster"] for r in ev.matched_clusters(matched).collect()}
    assert best == {"A": "Clusterg_00001_g_00003", "B": "not found", "C": "Clusterg_00001_g_00003"}
    metrics = {r["level"]: r for r in ev.gold_metrics(gold, matched, pred).collect()}
    assert (metrics["genes"]["matches"], metrics["genes"]["predicted"], metrics["genes"]["gold"]) == (6, 6, 9)
    assert (metrics["genes"]["precision"], metrics["genes"]["recall"], metrics["genes"]["f_measure"]) == (1.0, 0.667, 0.8)
    assert (metrics["clusters"]["matches"], metrics["clusters"]["predicted"], metrics["clusters"]["gold"]) == (2, 2, 3)


def test_metrics_without_matches_are_null(spark):
    gold = spark.createDataFrame([("A", "x")], "cluster_id string, gene string")
    pred = spark.createDataFrame([(0, ["y"], 0.9)], "pos long, genes array<string>, score double")
    for r in ev.gold_metrics(gold, ev.match_gold(gold, pred), pred).collect():
        if r["level"] == "genes":
            assert r["precision"] is None and r["recall"] is None and r["f_measure"] is None


def test_similarity_credit(spark):
    gold = spark.createDataFrame([("A", "g1"), ("A", "g2"), ("A", "g3")], "cluster_id string, gene string")
    pred = spark.createDataFrame([(0, ["g1", "p", "q"], 0.9)], "pos long, genes array<string>, score double")
    pairs = spark.createDataFrame(
        [("g2", "p", 80.0), ("g3", "p", 90.0), ("g2", "q", 80.0), ("g2", "g1", 99.0)], "a string, b string, pident double")
    matched = ev.match_gold(gold, pred)
    credit = ev.similarity_credit(matched, ev.matched_clusters(matched), pred, pairs).collect()
    # g2 ties on p and q and takes p, the first; p counts once with its highest value.
    assert [(r["cluster_id"], round(r["credit"], 6)) for r in credit] == [("A", 0.9)]


def test_gold_regions(spark):
    rows = [("near", "N_00003"), ("near", "N_00006"), ("far", "N_00001"), ("far", "N_00500")]
    gold = spark.createDataFrame(rows, "cluster_id string, gene string")
    got = {(r["cluster_id"], r["gene"]) for r in ev.gold_regions(gold).collect()}
    assert got == {("near", f"N_0000{i}") for i in (3, 4, 5, 6)} | {("far", "N_00001"), ("far", "N_00500")}


def test_gold_regions_of_long_numbers(spark):
    rows = [("a", "N_99998"), ("a", "N_100001"), ("b", "P_123450"), ("b", "P_123452"), ("c", "N_00009"), ("d", "N_99990"), ("d", "N_100500")]
    gold = spark.createDataFrame(rows, "cluster_id string, gene string")
    got = sorted((r["cluster_id"], r["gene"]) for r in ev.gold_regions(gold).collect())
    assert got == sorted(
        [("a", f"N_{i}") for i in range(99998, 100002)] + [("b", f"P_{i}") for i in range(123450, 123453)]
        + [("c", "N_00009"), ("d", "N_99990"), ("d", "N_100500")])


def test_overestimation(spark):
    schema = "pos long, genes array<string>"
    orig = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["d", "e"])], schema)
    post = spark.createDataFrame([(0, ["a", "b", "c", "d", "x"]), (5, ["e"]), (9, ["z"])], schema)
    regions = spark.createDataFrame([("a", "G"), ("d", "G"), ("e", "H")], "gene string, cluster_id string")
    best = {r["pos"]: r["original_pos"] for r in ev.best_original(post, orig).collect()}
    assert best == {0: 0, 5: 1, 9: None}
    rows = {r["pos"]: r for r in ev.overestimation(post, orig, regions).collect()}
    assert set(rows) == {0, 5}
    r = rows[0]
    assert (round(r["over_original"], 2), r["over_merged"], r["over_total"]) == (66.67, 50.0, 60.0)
    assert (rows[5]["over_original"], rows[5]["over_merged"]) == (0.0, 0.0)


def test_similar_pairs_shuffle_lines_only(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 4), rng.randint(1, 3), rng.randint(1, 5), float(rng.randint(1, 50))) for _ in range(90)] + [(None, 1, 2, 3.0), (1, None, 2, 90.0)]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = similar_pairs(spark, str(tmp_path))
    want: dict[tuple, float] = {}
    for p, n, s, q in rows:
        for p2, n2, s2, q2 in rows:
            if p and n and (p, n) == (p2, n2):
                key = f"P_{p:05d}x{s}", f"P_{p:05d}x{s2}"
                want[key] = max(want.get(key, 0.0), q + q2)
    got = out.collect()
    assert {(r["a"], r["b"]): r["pident"] for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "hashpartitioning(a" not in final and "hashpartitioning(l_partkey" in final


def test_similar_votes(spark):
    pairs = spark.createDataFrame([("u", f"n{i:02d}", float(i)) for i in range(20)], "a string, b string, pident double")
    kept = spark.createDataFrame([(f"n{i:02d}",) for i in range(13, 20)], "gene string")
    und = spark.createDataFrame([("u",), ("v",)], "gene string")
    got = {r["gene"]: (round(r["score"], 2), r["positive"]) for r in mt.vote_by_similar(und, pairs, kept).collect()}
    assert got == {"u": (0.7, True), "v": (0.0, False)}


def test_seed_similarity_matches_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ABCD") for _ in range(60)) for _ in range(6)]
    seqs = list(base)
    for s in base:
        for _ in range(3):
            t = list(s)
            for p in rng.sample(range(60), rng.randint(1, 8)):
                t[p] = rng.choice("ABCD")
            seqs.append("".join(t))
    seqs += [base[0]] * 5 + ["AB", "", "AAAAAAAAAAAA", "AAAAAAAAAAAAB"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    reps: dict[str, int] = {}
    for i, s in enumerate(seqs):
        reps.setdefault(s, i)
    grams = {i: {s[p:p + 4] for p in range(len(s) - 3)} for s, i in reps.items()}
    for t in (0.2, 0.5, 0.7, 1.0):
        want = {(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b]
                and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= t - 1e-12}
        got = {(r["a"], r["b"]): r for r in sim.seed_similarity(df, "id", "seq", 4, t).collect()}
        assert set(got) == want
        for (a, b), r in got.items():
            assert r["shared"] == len(grams[a] & grams[b])
    groups = {r["id"]: r["representative"] for r in sim.copy_groups(df, "id", "seq").collect()}
    assert groups == {i: reps[s] for i, s in enumerate(seqs)}


def test_ranked_sets_shuffle_kmers_once_and_go_on_as_numbers(spark):
    seqs = ["ABCABCABCD", "ABCDDDDDDD", "XYZWXYZW", "AB", "", None, "DDDDDQ", "CABCE"]
    sets = sim._ranked_sets(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "seq", 3)
    assert sets.schema["kmers"].dataType.simpleString() == "array<bigint>"
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(kmer") == 1
    grams = {i: {s[p:p + 3] for p in range(len(s or "") - 2)} for i, s in enumerate(seqs) if s is not None}
    df = {g: sum(g in v for v in grams.values()) for v in grams.values() for g in v}
    names: dict[str, int] = {}
    for r in sets.collect():
        shared = {g for g in grams.pop(r["id"]) if df[g] > 1}
        assert len(r["kmers"]) == len(set(r["kmers"])) == len(shared) and r["n"] - r["lone"] == len(shared)
        names[r["id"]] = r["n"]
    assert names == {0: 4, 1: 4, 6: 2, 7: 3}
    assert not any(df[g] > 1 for v in grams.values() for g in v)


def test_ontology_terms(spark):
    hits = spark.createDataFrame(
        [("q", "A", 1e-9, 80.0), ("q", "AB", 1e-9, 50.0), ("q", "C", 1e-3, 90.0)], "qseqid string, sseqid string, evalue double, qcovs double")
    mapping = spark.createDataFrame([("A", "GO:1; GO:2;"), ("AB", "GO:3"), ("A", "GO:2")], "entry string, goids string")
    got = {r["goid"] for r in mt.ontology_terms(mt.significant_subjects(hits), mapping).collect()}
    assert got == {"GO:1", "GO:2"}
    assert mt.alignment_table(hits.withColumns({"bitscore": F.lit(1.0), "pident": F.lit(1.0)}), 1e-4).count() == 2


def test_similarity_credit_makes_only_the_pairs_it_needs(spark):
    gold = spark.createDataFrame([("A", "x1"), ("A", "x2"), ("A", "p1"), ("B", "x1")], "cluster_id string, gene string")
    pred = spark.createDataFrame([(0, ["p1", "p2", "p3"], 0.9), (1, ["q1"], 0.9), (2, ["x1"], 0.1)], "pos long, genes array<string>, score double")
    pairs = spark.createDataFrame(
        [("x1", "p2", 60.0), ("x2", "p2", 80.0), ("x1", "p3", 40.0), ("p1", "p2", 90.0), ("x1", "p1", 99.0), ("x2", "q1", 99.0)], "a string, b string, pident double")
    matched = ev.match_gold(gold, pred)
    asked = []

    def make(wanted):
        asked.extend(r.b for r in wanted.collect())
        return pairs.join(wanted, "b", "left_semi")

    want = [(r.cluster_id, r.credit) for r in ev.similarity_credit(matched, ev.matched_clusters(matched), pred, pairs).collect()]
    got = [(r.cluster_id, r.credit) for r in ev.similarity_credit(matched, ev.matched_clusters(matched), pred, make).collect()]
    # x1 and x2 both take p2, which counts once; p1 is found, and q1 represents nothing.
    assert got == want == [("A", 0.8)]
    assert sorted(asked) == ["p2", "p3"]


def test_match_gold_shuffles_gold_once(spark):
    gold = spark.createDataFrame([("A", "x1"), ("A", "x1"), ("B", "x1")], "cluster_id string, gene string")
    pred = spark.createDataFrame([(0, ["x1"], 0.9)], "pos long, genes array<string>, score double")
    matched = ev.match_gold(gold, pred)
    assert sorted((r.cluster_id, r.label) for r in matched.collect()) == [("A", 1), ("B", 1)]
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [gene" in plan
