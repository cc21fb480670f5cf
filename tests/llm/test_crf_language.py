from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clusterloom.llm import crf_language as c
from clusterloom.llm.queries import QUERIES


def brute(e, t):
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            out[i, y] += w
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 2, 7, 0, 4]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    e, t = rng.normal(size=(sum(sizes), 3)) * 2, rng.normal(size=(3, 3))
    for block in (1, 2, 3, 8):
        got = c.marginals(e, offsets, t, block=block)
        for a, b in zip(offsets, offsets[1:]):
            if b > a:
                assert np.allclose(got[a:b], brute(e[a:b], t), atol=1e-9)


def test_switched_text_is_labelled_word_by_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = c.train(docs, F.lit(True))
    texts = docs.filter("lang in ('en', 'de') and n_chars > 400").select("lang", "text").limit(20).collect()
    en, de = (next(r.text for r in texts if r.lang == x) for x in ("en", "de"))
    mixed = " ".join(en.split()[:30] + de.split()[:30])
    (s,) = c.letter_words(pa.array([mixed]))
    p = c.marginals(c.emissions(c.features(s), m), s.word_offsets, m.transition)
    names = [m.labels[i] for i in p.argmax(axis=1)]
    half = len(names) // 2
    assert sum(x == "en" for x in names[:half]) >= 0.9 * half and sum(x == "de" for x in names[half:]) >= 0.9 * (len(names) - half)


def test_edge_texts(spark, sf_dir):
    m = c.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True))
    long = "the thing of and with " * 20000
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "“”…"), (5, "the and of with"), (5, "the and of with"), (None, long), (6, "ÉÉÉ")]
    docs = spark.createDataFrame([(i, t, "fr", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in c.predict(docs, m).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (4, "und", False), (5, "en", True), (None, "en", True)} < got
    assert c.predict(docs, m).count() == len(rows) and c.predict(docs.limit(0), m).count() == 0
    assert c.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert {r.lang_pred for r in c.predict(docs, None).collect()} == {"und"}


def test_long_texts_without_a_letter(spark, sf_dir):
    m = c.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True))
    rows = [(1, "12 – 15 € " * 60), (2, "“ ” … " * 5000), (3, "😀 " * 49), (4, "😀 " * 51), (5, "٣ ٤ " * 40), (6, "– " * 200 + "é"),
            (7, "– " * 60 + "THE OF AND"), (8, "– € " * 60 + "слово"), (9, "– " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in c.predict(docs, m).collect()}
    assert {i for i, x in got.items() if x == ("und", 0.0)} == {1, 2, 3, 4, 5, 9}
    assert all(got[i][0] != "und" and got[i][1] > 0 for i in (6, 7, 8))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_crf_language"](spark, sf_dir).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
