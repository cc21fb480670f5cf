from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import corpus as cp
from clusterloom.operators import policy as pl


def rewards(spark):
    rows = [("A", 0, 3), ("A", 1, -1), ("B", 0, -4), ("C", 2, 1), ("C", 3, -2), ("Z", 0, 0)]
    return spark.createDataFrame(rows, "domain string, file int, reward int")


def test_reward_table(spark):
    got = {r["domain"]: (r["r_keep"], r["r_skip"]) for r in pl.reward_table(rewards(spark), 0.5).collect()}
    # Z has no reward at all: keep does not exceed skip.
    assert got == {"A": (0.75, -0.75), "B": (-1.0, 1.0), "C": (-0.5, 0.5), "Z": (0.0, 0.0)}


def test_q_iteration(spark):
    table = pl.reward_table(rewards(spark), 0.5)
    seq = [("s", i, d) for i, d in enumerate("ABCAAB")] + [("t", 0, "B")]
    moves = pl.transitions(spark.createDataFrame(seq, "file string, pos long, state string"), ["file"])
    counts = {(r["state"], r["next_state"]): r["n"] for r in moves.collect()}
    assert counts == {("A", "B"): 2, ("B", "C"): 1, ("C", "A"): 1, ("A", "A"): 1, ("B", "B"): 2}
    q = {r["state"]: r for r in pl.q_iteration(table, moves, alpha=0.3, gamma=0.4, iterations=15, checkpoint_every=4).collect()}
    r = {k: (v["r_keep"], v["r_skip"]) for k, v in q.items()}
    want = {s: [0.0, 0.0] for s in r}
    for _ in range(15):
        new = {}
        for s in want:
            out = {n: c for (a, n), c in counts.items() if a == s}
            if not out:
                new[s] = want[s]
                continue
            ahead = sum(c * max(want[n]) for n, c in out.items()) / sum(out.values())
            new[s] = [0.7 * want[s][i] + 0.3 * (r[s][i] + 0.4 * ahead) for i in (0, 1)]
        want = new
    for s, row in q.items():
        assert row["q_keep"] == pytest.approx(want[s][0]) and row["q_skip"] == pytest.approx(want[s][1])
        # Both actions share their successor: values decide like the rewards.
        if s in "ABC":
            assert (row["q_keep"] >= row["q_skip"]) == (row["r_keep"] >= row["r_skip"])


def test_policy_application(spark):
    q = pl.reward_table(rewards(spark), 0.5).select(
        F.col("domain").alias("state"), "r_keep", "r_skip", F.col("r_keep").alias("q_keep"), F.col("r_skip").alias("q_skip"))
    domains = spark.createDataFrame(
        [("g1", 0, "A"), ("g1", 1, "C"), ("g2", 0, "B"), ("g3", 0, "new")], "gene string, pos int, domain string")
    policy = {r["gene"]: r for r in pl.domain_report(pl.gene_policy(domains, q), domains).collect()}
    assert {g: r["action"] for g, r in policy.items()} == {"g1": "keep", "g2": "skip", "g3": "keep"}
    assert policy["g1"]["domains"] == "A, C" and policy["g3"]["keep_reward"] == 0
    genes = spark.createDataFrame([(1, i, g) for i, g in enumerate(["g1", "g2", "g3", "g4"])], "c int, idx long, gene string")
    acts = pl.settle_undecided(pl.apply_policy(genes, pl.gene_policy(domains, q), True), ["c"])
    assert [r["action"] for r in acts.orderBy("idx").collect()] == ["keep", "skip", "keep", "skip"]  # 50 % is not above 50 %
    rebuilt = {r["score"]: r["genes"] for r in pl.rebuild_clusters(acts, ["c"]).collect()}
    assert rebuilt == {1.0: ["g1", "g3"], 0.0: ["g2", "g4"]}


@pytest.mark.parametrize("percent", [50, 40, 30, 52.6, 10, 100])
def test_replicas_follow_the_carry_loop(spark, percent):
    n = 50
    got = [r["replicas"] for r in cp.replica_counts(spark.range(n), "id", percent).orderBy("id").collect()]
    size = int((100 - percent) * n / percent + 1e-9)
    ratio = size / n
    d, hundredths, want = round(ratio - int(ratio), 2), 0, []
    step = round(d * 100)
    for _ in range(n):
        hundredths += step
        if hundredths >= 100:
            want.append(int(ratio + hundredths / 100 + 1e-9))
            hundredths = 0
        else:
            want.append(int(ratio))
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3])
def test_shuffle_keeps_blocks(spark, size):
    seqs = ["", "A", "AB", "ABC", "ABCDEFG", "ABCDEFGH", "ABCDEFGHI"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, s string")
    out = {r["id"]: r["o"] for r in df.select("id", cp.shuffle_blocks(F.col("s"), size, F.col("id")).alias("o")).collect()}
    for i, s in enumerate(seqs):
        blocks = [s[j:j + size] for j in range(0, len(s) - 1, size)]
        assert Counter(out[i]) == Counter("".join(blocks)) and len(out[i]) == sum(map(len, blocks))



def test_blocks_are_shuffled_a_text_at_a_time(spark):
    """Order follows the hash of a block's place and the salts; wide characters count once; null stays null."""
    from pyspark.sql import functions as F

    texts = [None, "", "é", "ab", "abc", "é😀xyzé", "".join(map(chr, range(200, 331)))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, s string")
    for size in (1, 2, 3):
        out = df.select("s", F.xxhash64("id", F.lit(4)).alias("h"), cp.shuffle_blocks(F.col("s"), size, F.col("id"), F.lit(4)).alias("o"))
        assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
        for s, h, o in out.collect():
            if s is None:
                assert o is None
                continue
            blocks = [s[j:j + size] for j in range(0, len(s) - 1, size)]
            keys = cp.int_hash(list(range(len(blocks))), h).view("int64") if blocks else []
            assert o == "".join(b for _, _, b in sorted(zip(keys, range(len(blocks)), blocks)))
    keys = spark.range(50).select(F.col("id").cast("int").alias("i")).select("i", F.xxhash64("i").alias("h"), F.xxhash64("i", (F.col("i") * -3)).alias("g"))
    rows = keys.collect()
    first = cp.int_hash([r["i"] for r in rows], 42)
    assert first.view("int64").tolist() == [r["h"] for r in rows]
    assert cp.int_hash([-3 * r["i"] for r in rows], first).view("int64").tolist() == [r["g"] for r in rows]


def test_split(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i in range(400)], "id long, label int")
    pos = df.filter("label = 1").count()
    out = cp.split_train_validation(df, "id", "label", 50, 20, seed=4)
    counts = Counter((r["label"], r["split"]) for r in out.collect())
    assert counts == {(1, "validation"): int(.2 * pos), (1, "train"): pos - int(.2 * pos),
                      (0, "validation"): int(.2 * pos), (0, "train"): pos - int(.2 * pos)}
    assert out.select("id").distinct().count() == 2 * pos
    with pytest.raises(ValueError):
        cp.split_train_validation(df, "id", "label", 5, 20)
    folds = Counter((r["label"], r["fold"]) for r in cp.stratified_folds(df, "id", "label").collect())
    assert len(folds) == 10 and max(folds[(1, f)] for f in range(5)) - min(folds[(1, f)] for f in range(5)) <= 1


def test_values_within_a_stated_distance_of_the_fixed_point(spark):
    import numpy as np
    import pytest

    rng = np.random.default_rng(3)
    n, gamma = 12, 0.7
    counts = rng.integers(0, 4, (n, n))
    counts[n - 1] = 0  # never seen in a sequence: stays at zero
    keep, skip = rng.normal(size=n), rng.normal(size=n)
    rewards = spark.createDataFrame([(f"s{i}", float(keep[i]), float(skip[i])) for i in range(n)], "domain string, r_keep double, r_skip double")
    moves = spark.createDataFrame([(f"s{i}", f"s{j}", int(counts[i, j])) for i in range(n) for j in range(n) if counts[i, j]],
                                  "state string, next_state string, n long")
    total = counts.sum(axis=1)
    share = counts / np.maximum(total, 1)[:, None]
    best = np.zeros(n)
    for _ in range(400):
        best = np.where(total > 0, np.maximum(keep, skip) + gamma * share @ best, 0)
    for alpha in (1.0, 0.6):
        got = {r.state: r for r in pl.q_iteration(rewards, moves, alpha=alpha, gamma=gamma, tolerance=1e-7, checkpoint_every=8).collect()}
        for i in range(n):
            ahead = gamma * share[i] @ best if total[i] else None
            want = (keep[i] + ahead, skip[i] + ahead) if total[i] else (0.0, 0.0)
            assert abs(got[f"s{i}"].q_keep - want[0]) < 1e-7 and abs(got[f"s{i}"].q_skip - want[1]) < 1e-7
    with pytest.raises(RuntimeError):
        pl.q_iteration(rewards, moves, alpha=0.01, gamma=gamma, tolerance=1e-9, iterations=8)


def test_fold_sums_read_occurrences_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [(i, i % 3, 1) for i in range(30)]
    occ = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), "instance_id long, idx long, cnt long")
    folds = spark.createDataFrame([(i, i % 2) for i in range(30)], "instance_id long, fold int")
    got = {(r["fold"], r["idx"], r["total"]) for r in cp.positive_features_per_fold(occ, folds).collect()}
    assert got == {(f, x, 5) for f in (0, 1) for x in (0, 1, 2)} and read.value == 30


def test_words_are_cut_once(spark, sf_dir):
    """The vocabulary follows from the counts, which read no text any more."""
    from clusterloom.bindings import features as bf

    counts = bf.word_counts(spark, sf_dir)
    vocab = bf.counted_vocabulary(counts)
    assert "FileScan" not in vocab._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("feature_type", "feature", "idx").collect()))
    assert rows(vocab) == rows(bf.word_vocabulary(spark, sf_dir))
