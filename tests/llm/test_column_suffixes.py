from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from clusterloom.llm import column_suffixes as c
from clusterloom.llm.queries import QUERIES


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((repr(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_spans int, key string")
    out = c.remove(docs, **options)
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())


def texts(rng, n):
    return "".join(rng.choice("abcdefgh ijkl\nmnéop") for _ in range(n))


def test_columns_against_all_pairs():
    rng = random.Random(2)
    for _ in range(20):
        core = bytes(rng.choice(b"ab") for _ in range(30))
        parts, group, shift = [], [], []
        for g in range(3):
            for _ in range(rng.randint(1, 8)):
                left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6)))
                parts.append(left + core[:rng.choice([20, 30])] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))))
                group.append(g)
                shift.append(len(left))
        got = c.sort_columns(np.array(group), parts, np.array(shift), 22)
        for i, t in enumerate(parts):
            want = [s for s in range(len(t) - 21) if any(
                j != i and group[j] == group[i] and (k := s - shift[i] + shift[j]) >= 0 and parts[j][k:k + 22] == t[s:s + 22]
                for j in range(len(parts)))]
            assert got[i].tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [texts(rng, n) for n in (399, 400, 401, 700, 1500)]
    rows = [(i, texts(rng, rng.randint(0, 900)) + rng.choice(passages)[rng.randint(0, 3):] + texts(rng, rng.randint(0, 300))) for i in range(60)]
    base = texts(rng, 3000)
    for i in range(100, 130):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    rows += [(200, base), (201, base), (None, base), (200, base), (202, None), (203, ""), (204, "z" * 1200), (205, "ab" * 500 + "c"),
             (206, passages[1]), (207, "é" * 250), (208, base[:399]), (209, texts(rng, 500) * 3)]
    want = brute(rows, 400)
    assert run(spark, rows) == want
    # Groups that are too large for one task give the same result on deeper levels.
    assert run(spark, rows, limit=3) == want
    assert run(spark, rows[:0]) == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_column_suffixes"](spark, sf_dir).collect())
    assert got == brute(rows, 400)
