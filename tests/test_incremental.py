from __future__ import annotations

from clusterloom.sources import incremental as inc
from clusterloom.sources import readers as rd


def test_runs_handle_new_files_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = rd.read_fasta(spark, str(folder), "fasta", stream=True).filter("seq <> 'SKIP'")
        return sorted((r["seq_id"], r["seq"]) for r in inc.ingest(stream, out, state).collect())

    assert run() == []
    (folder / "a.fasta").write_text(">a one\nAC\nGT\n>b\nSKIP\n")
    (folder / "other.txt").write_text(">x\nAC\n")
    assert run() == [("a", "ACGT")]
    (folder / "deep").mkdir()
    (folder / "deep" / "c.fasta").write_text(">c\nTT\n>a again\nACGT\n")
    grown = [("a", "ACGT"), ("a", "ACGT"), ("c", "TT")]
    assert run() == grown
    assert run() == grown


def test_genbank_stream_equals_the_plain_reader(spark, tmp_path):
    folder = tmp_path / "zoo"
    folder.mkdir()
    for i in range(3):
        (folder / f"r{i}.gbk").write_text(f"LOCUS       L{i}\nVERSION     V{i}.1\nORIGIN\n        1 acgt ac\n//\n")
    stream = rd.read_genbank(spark, str(folder), stream=True)
    got = inc.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = rd.read_genbank(spark, str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 3
