"""Ordered post-processing against plain models of the written rules, across chunk borders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import merge as mg
from clusterloom.operators import ordered
from clusterloom.operators.windows import sequence_windows, window_step


@pytest.fixture(params=[3, 1 << 16])
def chunk(request, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", request.param)


def contigs():
    rng = random.Random(3)
    shapes = {"none": [0.1] * 6, "all": [0.9] * 11, "last": [0.1] * 4 + [0.9] * 2, "one": [0.9]}
    for i in range(4):
        shapes[f"r{i}"] = [rng.choice([0.2, 0.4, 0.7, 0.5]) for _ in range(17)]
    return {c: [([f"{c}{j + k}" for k in range(rng.randint(1, 3))], s) for j, s in enumerate(v)] for c, v in shapes.items()}


def frame(spark, data):
    rows = [(c, j, g, s) for c, items in data.items() for j, (g, s) in enumerate(items)]
    return spark.createDataFrame(rows, "c string, pos long, genes array<string>, score double")


def collect(df):
    return sorted((r["c"], r["pos"], r["genes"], r["score"]) for r in df.collect())


def leader_of(items, n):
    out, i = {}, 0
    while i < len(items):
        if items[i][1] >= 0.5 and i < len(items) - n:
            out.update({j: i for j in range(i, i + n + 1)})
            i += n + 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("n", [1, 2])
def test_successive(spark, chunk, n):
    data = contigs()
    merged, relabelled = [], []
    for c, items in data.items():
        lead = leader_of(items, n)
        for j, (genes, score) in enumerate(items):
            at = lead.get(j, j)
            if at == j:
                members = [k for k in lead if lead[k] == j] or [j]
                genes_out = list(dict.fromkeys(g for k in members for g in items[k][0])) if len(members) > 1 else genes
                merged.append((c, j, genes_out, score))
            if at != j and score < 0.5:
                relabelled.append((c, j, [g for g in genes if g not in items[at][0]], items[at][1]))
            else:
                relabelled.append((c, j, genes, score))
    df = frame(spark, data)
    assert collect(mg.successive_merge(df, ["c"], n)) == sorted(merged)
    assert collect(mg.successive_relabel(df, ["c"], n)) == sorted(relabelled)


def test_carry_forward(spark, chunk):
    data, want = contigs(), []
    for c, items in data.items():
        last = None
        groups: dict[int, list[str]] = {}
        for j, (genes, score) in enumerate(items):
            if score >= 0.5:
                last = j
            at = last if last is not None and score < 0.5 and j - last <= 2 else j
            groups.setdefault(at, [])
            groups[at].append(j)
        for at, members in groups.items():
            genes = items[at][0] if len(members) == 1 else list(dict.fromkeys(g for k in members for g in items[k][0]))
            want.append((c, at, genes, items[at][1]))
    assert collect(mg.carry_forward_merge(frame(spark, data), ["c"], 2)) == sorted(want)


def test_majority_regroup(spark, chunk):
    data, want = contigs(), []
    rng = random.Random(4)
    lengths = {g: rng.randint(0, 6) for items in data.values() for genes, _ in items for g in genes if rng.random() < 0.8}
    for c, items in data.items():
        seen: dict[str, list[int]] = {}
        for genes, score in items:
            for g in genes:
                seen.setdefault(g, []).append(int(score >= 0.5))
        group, run, before = 0, 0, None
        for i, (g, labels) in enumerate(seen.items()):
            positive = sum(labels) / len(labels) >= 0.5
            if positive != before or (not positive and run >= 10):
                group, run = i, 0
            run += lengths.get(g, 0)
            before = positive
            want.append((c, group, i, g, float(positive)))
    votes = mg.majority_vote(frame(spark, data), ["c"])
    table = spark.createDataFrame(list(lengths.items()), "gene string, length long")
    got = mg.majority_regroup(votes, ["c"], table, max_length=10)
    assert sorted((r["c"], r["group"], r["gpos"], r["gene"], r["score"]) for r in got.collect()) == sorted(want)


def split_model(flags, do_filter, do_split, min_run, min_fragment):
    n, cut, edges = len(flags), [False] * len(flags), {0}
    i = 0
    while i < n:
        if flags[i]:
            j = i
            while j < n and flags[j]:
                j += 1
            if do_split and j - i >= min_run and j < n:
                edges.add(i)
                for k in range(i, j):
                    cut[k] = True
            i = j
        else:
            i += 1
    out, fragment, size, current = [], 0, 0, []
    for i in range(n):
        if i in edges and size >= min_fragment:
            out += current
            fragment, size, current = i, 0, []
        if not (cut[i] or (do_filter and flags[i])):
            current.append((fragment, i))
            size += 1
    return out + (current if size >= min_fragment else [])


@pytest.mark.parametrize("do_filter,do_split", [(True, True), (False, True), (True, False)])
def test_filter_and_split(spark, chunk, do_filter, do_split):
    rng = random.Random(5)
    cases = ["FFFkkkkk", "kkkkkFFF", "kkkkkFFFkkFFFkkkkkk", "kk", "FFF", "kkkkkFFkkkkk"]
    cases += ["".join(rng.choice("kkFF") for _ in range(40)) for _ in range(4)]
    rows = [(c, i, f"g{i}", ch == "F") for c, s in enumerate(cases) for i, ch in enumerate(s)]
    df = spark.createDataFrame(rows, "cluster int, idx long, gene string, flag boolean")
    got = mg.filter_and_split(df, ["cluster"], do_filter=do_filter, do_split=do_split, min_run=3, min_fragment=5)
    want = [(c, f, i) for c, s in enumerate(cases) for f, i in split_model([x == "F" for x in s], do_filter, do_split, 3, 5)]
    assert sorted((r["cluster"], r["fragment"], r["idx"]) for r in got.collect()) == sorted(want)


def test_weights(spark, chunk):
    rows = [(1, i, f"g{i}", w, a) for i, (w, a) in enumerate([
        (0.0, "keep"), (0.0, "undecided"), (0.0, "keep"), (2.0, "keep"), (0.0, "skip"), (0.0, "keep"), (1.5, "skip")])]
    df = spark.createDataFrame(rows, "c int, idx long, gene string, weight double, action string")
    dry = [r["action"] for r in mg.dry_islands(df, ["c"]).orderBy("idx").collect()]
    assert dry == ["skip", "undecided", "skip", "keep", "skip", "keep", "skip"]
    near = mg.neighbour_weights(df, ["c"]).orderBy("idx").collect()
    assert [r["action"] for r in near] == ["keep", "undecided", "keep", "keep", "keep", "keep", "skip"]
    assert [r["weight"] for r in near] == [0, 0, 1, 2, 1, 1, 1.5]


@pytest.mark.parametrize("length,overlap", [(10, 0), (10, 50), (7, 90), (43, 50), (44, 50)])
def test_windows(spark, chunk, length, overlap):
    rng = random.Random(6)
    lens = [3, 0, 25, 1, 1, 1, 12]
    seqs = [(f"s{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate(lens)]
    df = spark.createDataFrame([("c", *s) for s in seqs], "c string, id string, seq string")
    got = {r["window"]: (r["ids"], r["content"]) for r in sequence_windows(df, ["c"], "id", "seq", length, overlap).collect()}
    text, spans, at = "".join(s for _, s in seqs), [], 0
    for i, s in seqs:
        spans.append((i, at, at + len(s)))
        at += len(s)
    step, want = window_step(length, overlap), {}
    for w, a in enumerate(range(0, len(text) - length + 1, step)):
        want[w] = ([i for i, lo, hi in spans if lo < a + length and hi > a and hi > lo], text[a:a + length])
    assert got == want


def test_full_overlap_is_rejected():
    with pytest.raises(ValueError):
        window_step(10, 100)
