from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clusterloom.functions import protein as pr
from clusterloom.functions import scalar as sc
from clusterloom.functions import tokens as tk
from clusterloom.operators import features as ft


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(tk, "BLOCK", 5)


def sequences():
    rng = random.Random(2)
    fixed = ["", "A", "ABC", "AAAAAAA", "ABAABAABABAABA", "aßé😀xyzé"]
    return fixed + ["".join(rng.choice("ABC") for _ in range(n)) for n in (4, 5, 6, 9, 10, 11, 47)]


@pytest.mark.parametrize("k,tail", [(1, 0), (3, 0), (6, 0), (3, 1)])
def test_kmers(spark, small_blocks, k, tail):
    seqs = list(enumerate(sequences()))
    df = spark.createDataFrame(seqs, "id int, seq string")
    got = sorted((r["id"], r["pos"], r["feature"]) for r in tk.explode_kmers(df, "seq", k, pos_col="pos", tail=tail).collect())
    want = sorted((i, p + 1, s[p:p + k]) for i, s in seqs for p in range(len(s) - k - tail + 1))
    assert got == want


def test_kmer_range(spark, small_blocks):
    seqs = list(enumerate(sequences()))
    df = spark.createDataFrame(seqs, "id int, seq string")
    got = sorted((r["id"], r["pos"], r["feature"]) for r in tk.explode_kmer_range(df, "seq", "2to4", pos_col="pos").collect())
    want = sorted((i, p + 1, s[p:p + k]) for i, s in seqs for k in (2, 3, 4) for p in range(len(s) - k + 1))
    assert got == want


@pytest.mark.parametrize("size", [0, "5to3"])
def test_bad_size(size):
    with pytest.raises(ValueError):
        tk.parse_size(size)


@pytest.mark.parametrize("size", [2, 3, "2to5"])
def test_nonoverlapping_counts(spark, small_blocks, size):
    seqs = list(enumerate(sequences()))
    df = spark.createDataFrame([(str(i), "kmers", s) for i, s in seqs], "instance_id string, feature_type string, content string")
    got = {(r["instance_id"], r["feature"]): r["cnt"] for r in ft.kmer_occurrences(df, size).collect()}
    lo, hi = tk.parse_size(size)
    want = {}
    for i, s in seqs:
        for k in range(lo, hi + 1):
            for f in {s[p:p + k] for p in range(len(s) - k + 1)}:
                want[(str(i), f)] = s.count(f)
    assert got == want


def test_line_ngrams(spark):
    df = spark.createDataFrame([(1, "PF1.2\nx\nPF3\n\nGO:1")], "id int, content string")
    assert [r["feature"] for r in tk.explode_line_ngrams(df, "content").orderBy("pos").collect()] == ["PF1", "PF3", "GO:1"]
    two = [r["feature"] for r in tk.explode_line_ngrams(df, "content", 2).orderBy("pos").collect()]
    assert two == ["PF1", "x PF3", "PF3 ", " GO:1"]


def test_dispatch_needs_properties(spark):
    df = spark.createDataFrame([("a", "f", "protanalys", "MK")], "instance_id string, file string, feature_type string, content string")
    with pytest.raises(ValueError):
        tk.tokenize(df, "prot")


def test_scalars(spark):
    df = spark.createDataFrame([("/data/run/BGC0001.region001.gbk", ">ORG1_00129.1", ">a|b.1")], "p string, g string, h string")
    r = df.select(
        sc.label_from_name(F.col("p")).alias("label"), sc.base_name(F.col("p")).alias("base"),
        sc.file_stem(F.col("p")).alias("stem"), sc.extension(F.col("p")).alias("ext"),
        sc.species_from_path(F.col("p")).alias("species"), sc.normalize_gene_id(F.col("g")).alias("g"),
        sc.normalize_gene_id(F.col("h")).alias("h")).first()
    assert tuple(r) == (1, "BGC0001.region001.gbk", "BGC0001", ".gbk", "run", "ORG1_00129", "a|b.1")


def test_padding(spark):
    df = spark.createDataFrame([([0, 1, 2],), ([],)], "ids array<int>")
    pad = lambda n, how: [r[0] for r in df.select(ft.pad_ids(F.col("ids"), F.lit(n), how)).collect()]
    assert pad(5, "post") == [[1, 2, 3, 0, 0], [0] * 5]
    assert pad(2, "post") == [[2, 3], [0, 0]]
    assert pad(4, "pre") == [[0, 1, 2, 3], [0] * 4]


def test_protein_values(spark):
    """Published worked values: glycine mass, and the tryptic peptide MAEGEITTFTALTEKFNLPPGNYKKPKLLYCSNGGHFLRILPDGTVDGT..."""
    seq = ("MAEGEITTFTALTEKFNLPPGNYKKPKLLYCSNGGHFLRILPDGTVDGTRDRSDQHIQLQLSAESVGEVYIKSTETGQYLAMDTSGLLYGSQTPSEECLFLERLEENHYNTYTSKKHAEKNWFVGLKKNGSCKRGPRTHYGQKAILFLPLPV")
    df = spark.createDataFrame([(seq,), ("G",), ("",)], "seq string")
    c = pr.composition(F.col("seq"))
    rows = df.select(c["proteinMWeight"].alias("w"), c["proteinAroma"].alias("a"), c["proteinGravy"].alias("g"),
                     pr.isoelectric_point(F.col("seq")).alias("pi")).collect()
    assert round(rows[0]["w"], 2) == 17103.16
    assert round(rows[0]["a"], 4) == 0.0987
    assert round(rows[0]["pi"], 2) == 7.72
    assert round(rows[0]["g"], 4) == -0.5974
    assert round(rows[1]["w"], 4) == 75.0666 and rows[2]["w"] is None


def test_translation(spark):
    df = spark.createDataFrame([("ATGGCCTAANNATG",)], "s string")
    assert df.select(pr.translate_dna(F.col("s"))).first()[0] == "MA*X"
    frames = {r["frame"]: r["protein"] for r in pr.six_frames(df.select(F.lit("ATGAAA").alias("s")), "s").collect()}
    assert frames == {1: "MK", 2: "*", 3: "E", -1: "FH", -2: "F", -3: "S"}


def test_codons_are_looked_up_a_text_at_a_time(spark):
    """Foreign letters, digits and wide characters make X, each taking one place; null stays null."""
    texts = [None, "", "AT", "ATG", "ATGAC", "ATGé😀CTTT", "012ATG", "atgATG", "".join(a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG")]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").repartition(3)
    got = df.select("i", pr.translate_dna(F.col("s")).alias("p"))
    want = {0: None, 1: "", 2: "", 3: "M", 4: "M", 5: "MXF", 6: "XM", 7: "XM", 8: pr.CODON_TABLE}
    assert {r["i"]: r["p"] for r in got.collect()} == want
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
