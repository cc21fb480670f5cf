from __future__ import annotations

import random

import corpus_pipeline as c
from tests.llm.test_column_suffixes import brute as brute_repeats
from tests.llm.test_ngram_join import brute as brute_groups


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for i, (name, stage) in enumerate(c.STAGES):
        path = f"{tmp_path}/{i}"
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_every_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame(
        [(100000, None, None, "s", None), (100001, "", "en", "s", 0), (100002, "12 34", None, "s", 5), (100003, "the and of " * 4000, "en", "s", 44000)], docs.schema)
    _, spoken, apart, cut, clean, encoded = stages(spark, docs.unionByName(extra), sf_dir, tmp_path)
    assert all(x.columns == docs.columns for x in (spoken, apart, cut, clean))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before = ids(docs)
    assert ids(spoken) - before == {100003} and len(before - ids(spoken)) <= 0.01 * len(before)
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    assert ids(apart) == {i for _, n, i in brute_groups(rows) if n}
    rows = [(r.doc_id, r.text) for r in apart.collect()]
    lost = {d: (n, gone) for d, n, gone, _, _ in brute_repeats(rows, 400)}
    for r in cut.collect():
        n, gone = lost[repr(r.doc_id)]
        assert 0 <= n - gone - len(r.text.encode()) <= 6 * (gone > 0) * 20
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in cut.collect() if any(x in r.text for x in items)}
    assert holds <= ids(cut) - ids(clean) and len(ids(cut) - ids(clean)) <= len(holds) + 3
    assert ids(encoded) == ids(clean)


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert stages(spark, docs, sf_dir, tmp_path)[-1].count() == 0


def test_run_returns_the_last_stage(spark, sf_dir):
    assert c.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_cut_characters(spark):
    from clusterloom.llm import column_suffixes

    rng = random.Random(1)
    passage = "é" * 3 + "".join(rng.choice("abc é") for _ in range(500))
    docs = spark.createDataFrame([(1, "x" + passage + "Ã", None), (2, "yy" + passage + "Â", 3), (3, None, 1)], "doc_id long, text string, n_spans int")
    got = {r.doc_id: r.text for r in column_suffixes.remove_text(docs).collect()}
    assert got[3] is None and got[1] in ("x", "xÃ") and got[2] in ("yy", "yyÂ")


NAMES = ["kept", "n_bytes", "n_removed", "n_spans", "lang_pred", "lang_score", "lang_words", "_t", "_row", "_node", "_a", "starts", "component", "a", "key"]


def test_stages_keep_columns_of_any_name(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(100000, None, None, "s", None), (None, "the and of " * 300, "en", "s", 3)], docs.schema)
    both = docs.unionByName(extra)
    wide = both.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    for i, (name, stage) in enumerate(c.STAGES[:-1]):
        plain = sorted(map(repr, stage(spark, both, sf_dir).collect()))
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES), name
        assert sorted(repr(r) for r in spark.createDataFrame([tuple(r)[:len(both.columns)] for r in rows], both.schema).collect()) == plain, name
    assert c.STAGES[-1][1](spark, wide, sf_dir).count() == both.count()
