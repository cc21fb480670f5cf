"""Chunked scans against plain loops, with chunks far smaller than the sequences."""

from __future__ import annotations

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import ordered as o


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = [(c, rng.random(), i, rng.choice([0, 0, 0, 1, 5, 2]), rng.random() < 0.4)
            for c in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "c string, r double, i int, len int, f boolean")
    groups = {c: sorted((r for r in rows if r[0] == c), key=lambda r: r[1]) for c in "ab"}
    return o.index_rows(df, ["c"], ["r"]).cache(), groups


def by_contig(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["c"], []).append(r)
    return {c: sorted(v, key=lambda r: r["pos"]) for c, v in out.items()}


def test_dense_index(data):
    df, groups = data
    for c, rows in by_contig(df).items():
        assert [r["pos"] for r in rows] == list(range(60))
        assert [r["i"] for r in rows] == [g[2] for g in groups[c]]


def test_global_index(spark):
    df = o.index_rows(spark.range(1000).select((F.lit(1000) - F.col("id")).alias("v")), [], ["v"], "n")
    assert all(r["n"] == r["v"] - 1 for r in df.collect())


@pytest.mark.parametrize("chunk", [7, 100])
def test_scan(data, chunk):
    df, groups = data
    flagged = F.when(F.col("f"), F.col("pos"))
    out = o.scan(df, ["c"], "pos", chunk_rows=chunk, sums={"s": F.col("len")}, lasts={"l": flagged},
                 upcoming={"u": flagged}, prevs={"p": F.col("i")}, nexts={"n": F.col("i")},
                 totals={"t": F.lit(1)})
    for c, rows in by_contig(out).items():
        src, total = groups[c], 0
        for j, r in enumerate(rows):
            total += src[j][3]
            marks = [k for k in range(60) if src[k][4]]
            assert (r["s"], r["t"]) == (total, 60)
            assert r["l"] == max((k for k in marks if k <= j), default=None)
            assert r["u"] == min((k for k in marks if k >= j), default=None)
            assert r["p"] == (src[j - 1][2] if j else None)
            assert r["n"] == (src[j + 1][2] if j < 59 else None)


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_islands(data, chunk):
    df, groups = data
    for c, rows in by_contig(o.islands(df, ["c"], "pos", F.col("f"), chunk_rows=chunk)).items():
        flags = [g[4] for g in groups[c]]
        for j, r in enumerate(rows):
            a = b = j
            while a > 0 and flags[a - 1] == flags[j]:
                a -= 1
            while b < 59 and flags[b + 1] == flags[j]:
                b += 1
            assert (r["island_start"], r["island_end"]) == (a, b)


@pytest.mark.parametrize("stride,chunk,fan", [(1, 3, 2), (2, 7, 256), (3, 100, 256), (9, 7, 3), (20, 2, 4)])
def test_greedy_starts(data, stride, chunk, fan):
    df, groups = data
    sums = o.scan(df, ["c"], "pos", sums={"s": F.col("len")}).withColumn("x", F.col("s") - F.col("len"))
    got = o.greedy_starts(sums, ["c"], "pos", F.col("x"), stride, eligible=F.col("f"),
                          forced=F.col("i") % 13 == 5, chunk_rows=chunk, fan=fan)
    got = {c: [r["pos"] for r in rows] for c, rows in by_contig(got).items()}
    for c, src in groups.items():
        want, goal, x = [], float("-inf"), 0
        for j, g in enumerate(src):
            if g[2] % 13 == 5 or (g[4] and x >= goal):
                want.append(j)
                goal = x + stride
            x += g[3]
        assert got[c] == want


@pytest.mark.parametrize("forced", [True, False])
def test_greedy_starts_of_one_sequence(spark, forced):
    """All rows in one sequence, in a tree of many levels, against the serial walk."""
    rng = random.Random(4)
    rows, x = [], 0
    for i in range(400):
        rows.append((i, x, rng.random() < 0.6, forced and rng.random() < 0.02))
        x += rng.choice([0, 0, 1, 2, 40])
    df = spark.createDataFrame(rows, "pos long, x long, ok boolean, must boolean")
    got = o.greedy_starts(df, [], "pos", F.col("x"), 11, eligible=F.col("ok"), forced=F.col("must"), chunk_rows=9, fan=4)
    want, goal = [], float("-inf")
    for i, x, ok, must in rows:
        if must or (ok and x >= goal):
            want.append(i)
            goal = x + 11
    assert sorted(r["pos"] for r in got.collect()) == want


def test_composed_tables():
    """Tables composed in any order map every target as the tables one by one do."""
    rng = random.Random(9)
    for _ in range(200):
        stride, x, chunks = rng.randint(1, 12), 0, []
        for _ in range(rng.randint(2, 6)):
            xs, forced = [], []
            for _ in range(rng.randint(1, 5)):
                x += rng.choice([0, 1, 3, 9])
                xs.append(x)
                forced.append(rng.random() < 0.1)
            chunks.append(tuple(np.asarray(t, np.int64) for t in o._table_of(np.array(xs), np.array(forced), stride)))
        targets = np.arange(-3, stride + 1) + chunks[0][0][0] if chunks[0][0][0] < 1 << 40 else np.array([-5, 0, 5])
        want = targets
        for c in chunks:
            want = o._through(*c, want)
        cut = rng.randint(1, len(chunks) - 1)
        fold = lambda cs: functools.reduce(lambda a, b: o._compose(stride, a, b), cs)
        assert (o._through(*fold(chunks), targets) == want).all()
        assert (o._through(*o._compose(stride, fold(chunks[:cut]), fold(chunks[cut:])), targets) == want).all()


def test_neighbour_frame(data):
    df, groups = data
    out = o.neighbour_frame(df, ["c"], "pos", 2, before={"b": F.col("len")}, after={"a": F.col("len")}, chunk_rows=5)
    for c, rows in by_contig(out).items():
        lens = [g[3] for g in groups[c]]
        assert len(rows) == 60
        for j, r in enumerate(rows):
            assert r["b"] == sum(lens[max(j - 2, 0):j]) and r["a"] == sum(lens[j + 1:j + 3])
