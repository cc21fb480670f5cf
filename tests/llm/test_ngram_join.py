from __future__ import annotations

import random
import re

from clusterloom.llm import ngram_join as j
from clusterloom.llm.queries import QUERIES


def brute(rows, percent=80):
    sets = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index: dict = {}
    for i, s in enumerate(sets):
        for t in s:
            index.setdefault(t, []).append(i)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    names: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted((repr(d), len(sets[i]), names.get(find(i))) for i, (d, _) in enumerate(rows))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, 1) for d, t in rows], "doc_id long, text string, component_id int, n int")
    return sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in j.cluster(docs, **options).collect())


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, passage = [], [rng.choice(words) for _ in range(30)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 12, 60, 140]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 3, 45])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, (" " if g % 2 else "\n ").join(copy).upper() if g == 4 else " ".join(copy)))
    rows += [(3, rows[0][1]), (None, rows[0][1]), (1, None), (2, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE\ttwo"), (8, "one two three"),
             (6, "one two"), (None, "only this"), (9, "z " * 9000)]
    assert run(spark, rows) == brute(rows)
    # Small buckets and blocks, and hot tokens from two documents on, change nothing.
    hot, short = j.HOT, j.SHORT
    j.HOT, j.SHORT = 2, 4
    try:
        assert run(spark, rows, bucket_bytes=2000, block=7) == brute(rows)
    finally:
        j.HOT, j.SHORT = hot, short


def test_empty_table_and_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A b c d e f", "y"), (1, "A b c d e f", "y"), (3, None, "z"), (4, None, "z")],
                                 "doc_id long, text string, _extra string")
    assert sorted(tuple(r) for r in j.keep_one(docs).collect()) == [(1, "A b c d e f", "y"), (3, None, "z"), (4, None, "z")]
    assert j.cluster(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_join"](spark, sf_dir).collect())
    assert got == brute(rows)


def test_one_of_different_texts_with_one_id_stays(spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:199] + ["z"]
    far = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (1, " ".join(near)), (2, " ".join(words)), (None, " ".join(near)), (1, " ".join(far)),
            (None, " ".join(f"u{i}" for i in range(200))), (None, " ".join([f"u{i}" for i in range(199)] + ["z"]))]
    kept = j.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "u"), (1, "v"), (1, "w")]
