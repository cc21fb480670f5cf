"""Joined pieces, their digests and regions against plain string operations."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import match as mt
from clusterloom.operators import merge as mg
from clusterloom.operators import pieces as pc

ALPHABET = "ab\n é漢😀"


def folded(text: str, piece: int, fan: int) -> str:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(text[i:i + piece]) for i in range(0, max(len(text), 1), piece)]
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        level = [r[0] if len(r) == 1 else sha("".join(r)) for r in runs]
    return level[0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 40])))
    # The first group holds most rows; one has only empty and null texts.
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 5, word()) for i in range(120)]
    rows += [("none", 1, ""), ("none", 2, None), ("g0", 9000, None), ("long", 1, word() * 500 + "x")]
    joined: dict[str, str] = {}
    for g, p, t in sorted(rows, key=lambda r: r[1]):
        joined[g] = joined.get(g, "") + (t or "")
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, pos long, t string"), joined


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_joined_pieces(rows, piece):
    df, joined = rows
    got = {(r["g"], r["piece"]): (r["offset"], r["text"]) for r in pc.joined_pieces(df, ["g"], "pos", "t", piece).collect()}
    want = {(g, i // piece): (i, t[i:i + piece]) for g, t in joined.items() for i in range(0, max(len(t), 1), piece)}
    assert got == want


@pytest.mark.parametrize("piece,fan", [(7, 2), (64, 3), (1 << 20, 1024)])
def test_piece_digests(rows, piece, fan):
    df, joined = rows
    out = pc.piece_digests(pc.joined_pieces(df, ["g"], "pos", "t", piece), ["g"], fan).collect()
    assert {r["g"]: (r["n_chars"], r["digest"]) for r in out} == {g: (len(t), folded(t, piece, fan)) for g, t in joined.items()}


def test_region_texts(spark, rows):
    df, joined = rows
    rng = random.Random(3)
    regions = [(i, g, rng.randint(-3, len(t) + 3), rng.randint(-3, len(t) + 9)) for i, (g, t) in enumerate(joined.items()) for _ in [0]]
    regions += [(100, "hot", 0, len(joined["hot"])), (101, "hot", 5, 5), (102, "unknown", 0, 9), (103, "hot", -4, 30)]
    wanted = spark.createDataFrame(regions, "id long, g string, begin long, end long")
    out = pc.region_texts(pc.joined_pieces(df, ["g"], "pos", "t", 11), ["g"], wanted, "id", 11)
    assert {r["id"]: r["text"] for r in out.collect()} == {
        i: joined.get(g, "")[max(b, 0):max(e, 0)] for i, g, b, e in regions}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, pos long, t string")
    out = pc.joined_pieces(df, ["g"], "pos", "t")
    assert out.count() == 0 and pc.piece_digests(out, ["g"]).count() == 0


def test_one_group_without_parts(rows):
    df, _ = rows
    text = "".join(r["t"] or "" for r in sorted(df.collect(), key=lambda r: (r["pos"], r["g"])) if r["g"] == "hot")
    out = pc.joined_pieces(df.filter("g = 'hot'"), [], "pos", "t", 13).orderBy("piece").collect()
    assert "".join(r["text"] for r in out) == text


def test_callers_agree_with_whole_values(spark):
    seqs = spark.createDataFrame(
        [(f"c{i % 3}.{i}|x", i, "AC" * i) for i in range(20)], "seq_id string, pos long, seq string")
    whole = {r["cluster_id"]: r["seq"] for r in mt.concat_by_cluster(seqs).collect()}
    parts = mt.cluster_pieces(seqs, piece=8).orderBy("piece").collect()
    assert whole == {c: "".join(r["text"] for r in parts if r["cluster_id"] == c) for c in whole}

    texts = spark.createDataFrame(
        [(i, [None, "a", "b"][(i // 4) % 3], f"t{i}") for i in range(30)], "pos long, id string, t string")
    whole = {r["start"]: (r["id"], r["t"], r["n"]) for r in mg.group_consecutive(texts, [], "pos", "id", "t").collect()}
    runs, pieces = mg.consecutive_pieces(texts, [], "pos", "id", "t", piece=3)
    parts = pieces.orderBy("piece").collect()
    assert whole == {r["start"]: (r["id"], "".join(p["text"] for p in parts if p["start"] == r["start"]), r["n"])
                     for r in runs.collect()}


def test_runs_are_found_without_their_texts(spark):
    texts = spark.createDataFrame([(i, "ab"[i // 3 % 2], f"t{i}") for i in range(12)], "pos long, id string, long_text string")
    runs, pieces = mg.consecutive_pieces(texts, [], "pos", "id", "long_text", piece=4)
    assert "long_text" not in runs._jdf.queryExecution().analyzed().toString()
    got = pieces.filter("start = 3").orderBy("piece").collect()
    assert "".join(r["text"] for r in got) == "t3t4t5" and runs.count() == 4
