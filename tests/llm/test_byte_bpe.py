from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from clusterloom.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def expected(text):
    enc = tiktoken.Encoding(
        "t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(byte_bpe.read_ranks(PATH)), special_tokens={})
    return enc.encode_ordinary(text or "")


def test_chunks_stitch_like_the_library(spark):
    texts = [
        None, "", "a", "it's 12 o'clock   now\n\n  ok <|endoftext|>", "x" * 700, " " * 400 + "y", "é" * 333 + " \n" * 90,
        "don't we'll they're I'd " * 60, "!?" * 300, "ab12 " * 150 + "\t" * 77 + "z" * 200 + "'ll'll", "　漢字 " * 120,
        "word " * 40 + "q" * 260 + " tail of words that's long " * 9,
    ]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "ab12 " * 150, "e"), (5, " " * 400 + "y", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for chunk, overlap in ((50, 16), (64, 40), (31, 30), (1000, 100)):
        out = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap), PATH)
        got = sorted((repr(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in out.collect())
        want = sorted(
            (repr(i), np.array(expected(t), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
        assert got == want, (chunk, overlap)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH).count() == 0


def test_query_digests(spark, sf_dir):
    from clusterloom.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op1_byte_bpe"](spark, sf_dir).filter(F.col("doc_id") % 7 == 0).collect():
        ids = expected(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
