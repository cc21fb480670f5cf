from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import learn as ln
from clusterloom.plans import corpus as pc
from clusterloom.plans import features as pf
from clusterloom.sources import readers as rd


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(folder)


def test_fasta(spark, tmp_path):
    put(tmp_path, "deep/a.fasta", ">one words here\r\nAC\r\nGT\r\n>two\nTTT\n\n>three\n")
    put(tmp_path, "b.fasta", ">four\nA")
    put(tmp_path, "skip.txt", ">five\nA")
    rows = {r["seq_id"]: r["seq"] for r in rd.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {"one": "ACGT", "two": "TTT", "three": "", "four": "A"}


GBK = """LOCUS       X1
VERSION     X1.1
  ORGANISM  Mould
FEATURES             Location/Qualifiers
     CDS             join(1..3,
                     5..9)
                     /gene="abc"
                     /locus_tag="T_1"
                     /product="long
                     name"
                     /function="f"
                     /translation="MK
                     LV"
     gene            1..2
                     /gene="other"
     CDS             7..9
                     /protein_id="p/1"
                     /translation="MA"
ORIGIN
        1 atggcc taa
//
LOCUS       X2
ORIGIN
        1 acgt
//
"""


def test_genbank(spark, tmp_path):
    put(tmp_path, "Sp/x.region007.gbk", GBK)
    records = rd.read_genbank(spark, str(tmp_path))
    by_id = {r["record_id"]: r for r in records.collect()}
    assert (by_id["X1.1"]["seq"], by_id["X1.1"]["organism"], by_id["X2"]["seq"]) == ("ATGGCCTAA", "Mould", "ACGT")
    entries = {r["header"]: r["seq"] for r in rd.genbank_proteins(records).collect()}
    assert entries == {"X1.1|Sp|T_1|long name|f": "MKLV", "X1.1|Sp|p1|": "MA"}
    t = {r["seq_id"]: (r["protein"], r["cds_protein"]) for r in rd.genbank_translations(records).collect()}
    assert t["X1.1007"] == ("MA*", "MKLVMA")


def test_dataset(spark, tmp_path):
    put(tmp_path, "g1.1.bgc.domains", ">g1.1\nPF1.2|a\nPF3.4|b\n")
    put(tmp_path, "g2.domains", ">g2.1\n")
    put(tmp_path, "g1.fasta", ">g1.1\nmkbxz-v\n")
    rows = rd.read_dataset(spark, str(tmp_path), "kmers-domains").collect()
    assert sorted((r["instance_id"], r["feature_type"], r["content"]) for r in rows) == [
        ("g1", "domains", "PF1\nPF3"), ("g1", "kmers", "MKV")]
    lines = rd.read_dataset(spark, str(tmp_path), "domains", per_domain=True)
    assert sorted(r["content"] for r in lines.collect()) == ["", "PF1", "PF3"]
    with pytest.raises(ValueError):
        rd.read_dataset(spark, str(tmp_path), "go")


def test_prediction_and_reward_files(spark, tmp_path):
    put(tmp_path, "p/ids.test", "b||c|\t0.7\na\t0.2\n")
    got = [(r["pos"], r["genes"], r["score"]) for r in rd.read_predictions(spark, str(tmp_path / "p")).orderBy("pos").collect()]
    assert got == [(0, ["a"], 0.2), (1, ["b", "c"], 0.7)]
    put(tmp_path, "r/x.feat", "PF1.2|nm\t1,-1\nplain\t0,2\n")
    got = {r["domain"]: r["rewards"] for r in rd.read_rewards(spark, str(tmp_path / "r")).collect()}
    assert got == {"PF1": [1, -1], "plain": [0, 2]}
    put(tmp_path, "m/logit_kmers6_domains_len70_overlap50_x.IDs.test.merge.succ2.eval.metrics", "h\n\tP\npos\t0.5\t0.6\n")
    row = rd.summarize_metrics(spark, str(tmp_path / "m")).first()
    assert (row["features"], row["length"], row["overlap"], row["variant"], row["metrics"]) == (
        "kmers6+domains", "70", "50", "merge2", "0.5\t0.6")


def test_metrics_files_are_opened_once(spark, tmp_path):
    """The sort of the summary reads no file again."""
    for i in (3, 1, 2):
        put(tmp_path, f"m/logit_kmers6_domains_len{i}0_overlap50_x.IDs.test.succ2.eval.metrics", f"h\n\tP\npos\t0.{i}\t0.6\n")
    out = rd.summarize_metrics(spark, str(tmp_path / "m"))
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["length"], r["metrics"]) for r in out.collect()] == [(f"{i}0", f"0.{i}\t0.6") for i in (1, 2, 3)]


def test_train_and_predict(spark, tmp_path):
    rng = random.Random(3)
    for part, n in (("train", 16), ("test", 6)):
        for i in range(n):
            kind, letters = ("bgc", "AACG") if i % 2 else ("neg", "TTGC")
            seq = "".join(rng.choice(letters) for _ in range(60))
            put(tmp_path / part, f"{kind}{part}{i}.fasta", f">{kind}{part}{i}\n{seq}\n")
            put(tmp_path / part, f"{kind}{part}{i}.domains", f">{kind}{part}{i}\nPF{i % 2}.1|x\n")
    scored, report = pf.train_and_predict(
        spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "model"), "kmers-domains", "randomforest",
        size=2, min_occ=1, source_type="nucleotide", numTrees=10, seed=1)
    assert scored.count() == 6 and report.first()["accuracy"] == 1.0
    reduced, _ = pf.train_and_predict(
        spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "model2"), "kmers", "logit",
        size=2, min_occ=1, source_type="nucleotide", components=2)
    assert reduced.count() == 6


def test_protein_features(spark):
    rows = [("a", "f", "protanalys", "MKWVTFISLLFLFSSAYS"), ("b", "f", "protanalys", "")]
    contents = spark.createDataFrame(rows, "instance_id string, file string, feature_type string, content string")
    vocab = pf.extract_features(contents, "prot")
    names = {r["feature"] for r in vocab.collect()}
    assert {"proteinMWeight", "proteinIsoelec", "proteinSecstruc-1", "protein-M"} <= names
    matrix = pf.feature_matrix(contents, vocab)
    assert matrix.filter("instance_id = 'a'").count() == len(names) and matrix.filter("instance_id = 'b'").count() == 0
    padded = pf.encoded_dataset(contents.filter("content <> ''"), vocab, "prot").first()
    assert padded["size"] == len(padded["padded"]) == len(names) and padded["label"] == 0


def test_policy_and_gff_plans(spark, tmp_path):
    rows = [("x/bgc1", "1", "domains", "A\nB"), ("x/neg1", "2", "domains", "B\nB"), ("x/bgc2", "3", "domains", "A")]
    contents = spark.createDataFrame(rows, "file string, instance_id string, feature_type string, content string")
    q = {r["state"]: r for r in pc.train_policy(contents, str(tmp_path / "q"), iterations=5).collect()}
    assert q["A"]["r_keep"] == 1.0 and q["B"]["r_skip"] == 1.0 and q["A"]["q_keep"] > q["A"]["q_skip"]
    put(tmp_path / "gff", "g.gff3", "##gff-version 3\n" + "\n".join(
        f"chr1\ts\t{t}\t{i * 10}\t{i * 10 + 5}\t.\t+\t0\tID=x{i};Name=g{i}.1" for i in (1, 2) for t in ("mRNA", "gene")) + "\n")
    clusters = spark.createDataFrame([("C", "g1"), ("C", "g2"), ("C", "g9")], "cluster_id string, gene string")
    gold = spark.createDataFrame([("g2",)], "gene string")
    ann = spark.createDataFrame([("g1", "backbone PKS")], "gene string, type string")
    missing = pc.clusters_to_gff(clusters, rd.read_gff(spark, str(tmp_path / "gff")), str(tmp_path / "out"), "set", gold, ann)
    assert [r["gene"] for r in missing.collect()] == ["g9"]
    lines = sorted(r["line"] for r in rd.read_lines(spark, str(tmp_path / "out/pergene")).collect() if not r["line"].startswith("##"))
    assert lines == ["chr1\tset\t10\t15\t?\t+\t0\tName=g1;Note=C;color=#EE0000", "chr1\tset\t20\t25\t?\t+\t0\tName=g2;Note=C;color=#9931f2"]


def test_dataset_plans(spark, tmp_path):
    put(tmp_path / "scan", "s.out", "# head\n\n a 1 9 1 9 PF1.2 Dom Domain 1 2 3 45.9 1e-5 1 CL1\n b 2 9 1 9 PF2.2 D2 Domain 1 2 3 4 1 1 CL1 site\n")
    hits = rd.read_domain_hits(spark, str(tmp_path / "scan"))
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    assert tuple(pc.domain_dataset(hits, ids, str(tmp_path / "dom")).first()) == (2, 1)
    assert {r["body"] for r in rd.read_headed_records(spark, str(tmp_path / "dom"), None).collect()} == {"PF1.2|Dom", "PF2.2|D2"}
    put(tmp_path / "fa", "x.fasta", ">a\nACGTACGTAA\n>b\nACGTACGTAC\n>c\nACGTACGTAA\n")
    pc.similarity_table(spark, str(tmp_path / "fa"), str(tmp_path / "sim"), 4, 0.5)
    pairs = rd.read_similarity(spark, str(tmp_path / "sim/similarity")).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [("a", "b")]


def test_unmatched_gff_columns_and_repeated_ids(spark):
    from clusterloom.operators.windows import sequence_windows
    from clusterloom.sources import writers as wr

    rows = spark.createDataFrame([(None, 1, 2, None, None, "c"), ("s", None, 9, "+", "0", "d")], "seqid string, start int, end int, strand string, phase string, name string")
    lines = {r["line"] for r in wr.gff_lines(rows, "src", F.lit("n"), F.col("name")).collect()}
    assert lines == {".\tsrc\t1\t2\t?\t.\t.\tName=c;Note=n", "s\tsrc\t.\t9\t?\t+\t0\tName=d;Note=n"}
    seqs = spark.createDataFrame([("p", "x", "AAAA"), ("p", "x", "CCCC")], "part string, id string, seq string")
    got = sorted(r["content"] for r in sequence_windows(seqs, ["part"], "id", "seq", 4, 0).collect())
    assert got == ["AAAA", "CCCC"]


def test_text_files_keep_quotes_and_order(spark, tmp_path):
    from clusterloom.sources import writers as wr

    words = ['a"b', '"', "c,d", "plain"]
    wr.write_tsv(spark.createDataFrame([(w,) for w in words], "feature string"), str(tmp_path / "w"), header=False)
    assert {r["feature"] for r in rd.read_dictionary(spark, str(tmp_path / "w")).collect()} == set(words)
    put(tmp_path / "v", "v.txt", "3 2\nzeta 1 2\nalpha 3 4\nmid 5 6\n")
    assert {r["feature"] for r in rd.read_word_vectors(spark, str(tmp_path / "v"), 2).collect()} == {"zeta", "alpha"}
    put(tmp_path / "o", "o.tsv", "Orthogroup\tx\nG9\ta, b\nG1\tc\n")
    assert [(r["group_id"], r["members"]) for r in rd.read_orthogroups(spark, str(tmp_path / "o"), 1).collect()] == [("G9", ["a", "b"])]
    put(tmp_path / "g", "g.gff", 's\t"x\tmRNA\t1\t2\t.\t+\t0\tName=g1.10;ID=1;ID=2\n')
    assert rd.mrna_features(rd.read_gff(spark, str(tmp_path / "g"))).first()["name"] == "g1.10"


def test_vectors_of_instances_without_features(spark):
    occ = spark.createDataFrame([("a", 1, 2)], "instance_id string, idx long, cnt long")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "instance_id string, label int")
    rows = {r["instance_id"]: r["features"].toArray().tolist() for r in ln.labelled(ln.feature_vectors(occ, 3, labels), labels).collect()}
    assert rows == {"a": [0, 2, 0], "b": [0, 0, 0]}


@pytest.mark.parametrize("rows", [60, 700])
def test_local_outliers_exact(spark, rows):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(rows, 3)), [[8.0, 8.0, 8.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    k, n = 5, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = np.array([1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)])
    want = np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])
    got = {r["id"]: r for r in ln.local_outliers(ln.nearest_neighbours(df, "id", "v", k=k, block=256), "id").collect()}
    assert np.allclose([got[i]["factor"] for i in range(n)], want, rtol=1e-6)
    assert got[rows]["prediction"] == -1
    iso = {r["id"]: r for r in ln.isolation_labels(df, "id", "v", trees=30).collect()}
    assert iso[rows]["score"] == max(r["score"] for r in iso.values()) and iso[rows]["prediction"] == -1
    cov = {r["id"]: r for r in ln.covariance_labels(df, "id", "v", 3).collect()}
    assert cov[rows]["prediction"] == -1 and sum(r["prediction"] == -1 for r in cov.values()) <= rows // 10 + 1


def test_fourier_features_approximate_the_kernel(spark):
    x = [[0.0, 0.0], [0.5, -0.3], [2.0, 1.0]]
    df = spark.createDataFrame([(i, [0, 1], v) for i, v in enumerate(x)], "instance_id int, indices array<int>, values array<double>")
    z = np.array([r["features"].toArray() for r in ln.fourier_features(df, 0.4, 2000).orderBy("instance_id").collect()])
    want = np.exp(-0.4 * ((np.array(x)[:, None] - np.array(x)[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_reports(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    rows = {r["label"]: r for r in ln.class_report(df).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[0]["support"], rows[0]["accuracy"]) == (1.0, 0.5, 2, 0.75)
    assert sorted(map(tuple, ln.confusion(df).collect())) == [(0, 2, 0), (1, 1, 1)]
    only = ln.class_report(df.withColumn("prediction", F.lit(0)))
    assert {r["label"]: r["precision"] for r in only.collect()}[1] == 0.0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_value_at_share(spark, share):
    values = sorted([3.0, 1.0, 1.0, 1.0, 7.5, 2.0, 2.0, 9.0, 4.0, 5.0])
    want = next(v for v in values if sum(w <= v for w in values) >= share * len(values) - 1e-9)
    df = spark.createDataFrame([(v,) for v in values[::-1]], "d double")
    assert ln._value_at_share(df, "d", share) == want
    assert ln._value_at_share(df.filter("d > 100"), "d", share) is None
