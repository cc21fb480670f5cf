from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import similarity as sim
from clusterloom.sources import readers as rd
from clusterloom.sources import records as rc


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def joined(rows):
    whole = {}
    for r in sorted(rows, key=lambda r: (r.file, r.record, r.piece)):
        whole.setdefault((r.file.rsplit("/", 1)[1], r.record, r.seq_id), []).append(r.text)
    return whole


def test_fasta_records_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = {}
    for f in range(3):
        text, at = "stray line\n\n" if f == 1 else "", 0
        for i in range(rng.randint(3, 8)):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 59, 60, 400, 5000])))
            text += f">s{i} of {f}\n" + "".join(seq[j:j + 60] + rng.choice(["\n", "\r\n", " \n", "\n\n"]) for j in range(0, len(seq), 60))
            if seq:
                want[f"{f}.fasta", i, f"s{i}"] = seq
        (tmp_path / f"{f}.fasta").write_text(text)
    for piece in (7, 100, 1 << 20):
        out = rc.read_pieces(spark, str(tmp_path), "fasta", piece=piece)
        got = joined(out.collect())
        assert {k: "".join(v) for k, v in got.items()} == want
        assert all(len(x) == piece for v in got.values() for x in v[:-1])
    plain = {r.seq_id + r.file[-7:]: r.seq for r in rd.read_fasta(spark, str(tmp_path)).collect() if r.seq and r.seq_id[0] == "s" and r.seq_id[1:].isdigit()}
    assert plain == {k[2] + k[0][-7:]: v for k, v in want.items()}


def test_origin_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    want, text = {}, ""
    for i in range(9):
        seq = "".join(rng.choice("acgt") for _ in range(rng.choice([0, 10, 61, 3000])))
        text += f"LOCUS       L{i}\nVERSION     V{i}.1\nFEATURES\n     CDS  1..9\n" + "COMMENT     words\n" * rng.randint(0, 30) + "ORIGIN\n"
        text += "".join(f"{j + 1:9d} " + " ".join(seq[k:k + 10] for k in range(j, min(j + 60, len(seq)), 10)) + "\n" for j in range(0, len(seq), 60)) + "//\n"
        if seq:
            want["a.gbk", i, f"V{i}.1"] = seq.upper()
    (tmp_path / "a.gbk").write_text(text)
    got = joined(rc.read_pieces(spark, str(tmp_path), "gbk", "genbank", 90).collect())
    assert {k: "".join(v) for k, v in got.items()} == want


def test_contained_sequences_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(4, 80))) for _ in range(30)]
    rows = list(enumerate(base + [b[5:5 + rng.randint(3, 40)] + "XYZ" for b in base] + base[:4] + ["", "AB"]))
    data = spark.createDataFrame(rows, "id long, seq string")
    first = {}
    for i, s in rows:
        first.setdefault(s, i)
    grams = {i: {s[j:j + 4] for j in range(len(s) - 3)} for s, i in first.items()}
    for coverage in (0.0, 0.3, 0.5, 0.9):
        want = sorted((a, b, len(x & y)) for a, x in grams.items() for b, y in grams.items() if a != b and len(x & y) > coverage * len(x) + 1e-9)
        got = sim.contained_sequences(data, "id", "seq", 4, coverage).collect()
        assert sorted((r["query"], r.subject, r.shared) for r in got) == want and want
        assert all(abs(r.qcov - r.shared / len(grams[r["query"]])) < 1e-12 for r in got)
