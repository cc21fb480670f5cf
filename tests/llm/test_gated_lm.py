from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clusterloom.llm import gated_lm as g
from clusterloom.llm.queries import QUERIES
from clusterloom.llm.words import word_slices


def words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]


def plain(rows, training):
    counts = Counter(x for d, t in rows if training(d) for x in words(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(repr(d), len(words(t)), sum(counts[x] > 0 for x in words(t)),
                round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in words(t)), 6)) for d, t in rows]


def small():
    text = "a b a c d a b e f. the the g é a" * 3
    (s, h), = word_slices(pa.array([text]))
    shape = g.shape_of(s)
    u, first, c = np.unique(h, return_index=True, return_counts=True)
    order = np.lexsort((u, -c))
    heads = 5
    mass = np.ones(g.SHAPES)
    np.add.at(mass, shape[first][order[heads:]], c[order[heads:]] + 1)
    rank = np.argsort(order)
    return g.Words(u, c, np.where(rank < heads, rank, -1), mass, c[order[:heads]], len(h) + 1, len(u) + 1, 1), s, h


def test_probabilities_sum_to_one():
    w, s, h = small()
    p = g.start_weights(w)
    state = np.random.default_rng(0).normal(size=(1, g.HIDDEN)).astype(np.float32)
    classes = -(-len(w.head_counts) // g.CLASS_WORDS)
    total = 0.0
    for word in range(len(w.head_counts)):
        v, _ = g.outputs(p, state, np.array([word // g.CLASS_WORDS]), np.array([word % g.CLASS_WORDS]), None)
        total += np.exp(v[0])
    for c in range(classes, classes + 1 + g.SHAPES):  # within a shape the counts share the class's mass
        total += np.exp(g.outputs(p, state, np.array([c]), np.array([-1]), None)[0][0])
    assert abs(total - 1) < 1e-4


def test_gradient_matches_differences():
    w, s, h = small()
    b = g.tokens(s, h, w)
    heads = len(w.head_counts)
    ids = g.input_ids(b.cls, b.slot, heads)[:24].reshape(12, 2)
    cls, slot = b.cls[:24].reshape(12, 2), b.slot[:24].reshape(12, 2)
    starts = np.zeros((12, 2), bool)
    starts[5, 1] = True
    base = {k: v.astype(np.float64) for k, v in g.start_weights(w).items()}
    rng = np.random.default_rng(1)
    for v in base.values():
        v += rng.normal(size=v.shape) * 0.1

    def loss(p):
        h0, total = np.zeros((2, g.HIDDEN)), 0.0
        state = h0
        for i in range(12):
            state = np.where(starts[i][:, None], 0, state)
            total += g.outputs(p, state, cls[i], slot[i], None)[0].sum()
            k, a, x = g.HIDDEN, state @ p["recur"], p["embed"][ids[i]] + p["bias"]
            gate = 1 / (1 + np.exp(-(x[:, :2 * k] + a[:, :2 * k])))
            state = state + gate[:, :k] * (np.tanh(x[:, 2 * k:] + gate[:, k:] * a[:, 2 * k:]) - state)
        return total / ids.size

    moved = {k: v.astype(np.float32) for k, v in base.items()}
    squares = {k: np.full(v.shape, 1e6, np.float32) for k, v in moved.items()}
    g._train_window(moved, ids, cls, slot, starts, np.zeros((g.HIDDEN, 2), np.float32), squares, 1e6)
    for name in base:
        step = (moved[name].astype(np.float64) - base[name]) / 1e3  # rate over the root of the squares
        for at in np.argsort(-np.abs(step).ravel())[:3]:
            i = np.unravel_index(at, step.shape)
            up = {k: v.copy() for k, v in base.items()}
            down = {k: v.copy() for k, v in base.items()}
            up[name][i] += 1e-4
            down[name][i] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - step[i]) < 2e-3 + 0.05 * abs(step[i]), name


def test_the_tail_of_a_slice_is_trained_on(monkeypatch):
    seen, outputs = [], g.outputs
    monkeypatch.setattr(g, "outputs", lambda p, h, cls, slot, grads: (seen.extend(zip(cls, slot)), outputs(p, h, cls, slot, grads))[1])
    rng = np.random.default_rng(3)
    heads, k = 64, g.HIDDEN
    for n in (1, 5, 30, 383, 24 * 384 + 383, 25 * 384 * 2):
        cls = rng.integers(0, 2, n)
        slot = rng.integers(0, g.CLASS_WORDS, n)
        size = int(g.input_ids(cls, slot, heads).max()) + 1
        rand = lambda *x: rng.normal(size=x).astype(np.float32) * 0.1
        p = {"embed": rand(size, 3 * k), "recur": rand(k, 3 * k), "bias": rand(3 * k), "class": rand(k, 3), "class_bias": rand(3),
             "inner": rand(2, k, g.CLASS_WORDS), "inner_bias": rand(2, g.CLASS_WORDS)}
        squares = {name: np.full_like(v, 1e-2) for name, v in p.items()}
        b = g.Batch(offsets=np.array([0, n // 2, n]), cls=cls, slot=slot, count=np.zeros(n), hash=np.zeros(n, np.uint64))
        g.train_slice(p, b, heads, squares, 0.02)
        assert sorted(seen) == sorted(zip(cls, slot)) and all(np.isfinite(v).all() for v in p.values())
        seen.clear()


def test_state_is_carried_over_windows():
    w, s, h = small()
    b = g.tokens(s, h, w)
    p = g.start_weights(w)
    p["class"] += np.random.default_rng(2).normal(size=p["class"].shape).astype(np.float32)
    args = (p, np.tile(b.cls, 3), np.tile(b.slot, 3), np.array([len(b.cls), 2 * len(b.cls), 0]), len(w.head_counts))
    for window in (1, 7, 1000):
        assert np.allclose(g.score_rows(*args, window=window), g.score_rows(*args), atol=1e-3)


def test_counts_and_base_against_plain_python(spark):
    rows = [(i, f"the cat {i % 7} and the Dog\tsat\n on w{i} " * (i % 4)) for i in range(80)] + [(500, None), (501, ""), (None, "the cat"), (7, "x y"), (7, "x y"),
                                                                                          (502, "é É Éa"), (503, "long word " * 30000)]
    docs = spark.createDataFrame([(d, t, 1, 2.0) for d, t in rows], "doc_id long, text string, n_tokens int, score double")
    training = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))
    for table in (g.TABLE, 6):
        out, n = g.score_documents(docs, training, head=4, table=table)
        want_n, want = plain(rows, lambda d: d is not None and d % 5 != 0)
        got = out.collect()
        assert n == want_n and all(r.score < 0 for r in got)
        assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
    empty, n = g.score_documents(docs.limit(0), training)
    assert n == 0 and empty.count() == 0
    assert g.score_documents(docs, F.lit(False))[0].count() == len(rows)


def test_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, want = plain(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    rows = QUERIES["op6_gated_lm"](spark, sf_dir).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == sorted(want)
    assert {r.train_tokens for r in rows} == {n}
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
