"""Document log-likelihood under a gated recurrent language model (operator 6).

Tokens are the words of a text, A-Z lower-cased, and one end. All words of the training part are
counted. The ``head`` most frequent ones are predicted one by one, in classes of ``class_words``;
the end has a class of its own; all other words fall into shape classes (their last byte), within
which a word has its count plus one out of the class's total, and unseen words share one slot. So
the output is a class softmax times a softmax within the class, or times a count ratio.

A gated recurrent unit reads the words. Training is truncated backpropagation in numpy: texts run
side by side in lanes, the state is carried from one window to the next, gradients stop at the
window. Every training text is read once: rounds take growing parts of the texts, each task trains
from the round's weights on its own texts, and weights are averaged by tokens, in a tree. Tasks get
their texts by hash, in the order of another hash, so weights do not depend on a table's splits. Scoring
carries the state through whole texts, so a score is that of the complete document.

Only counts of the ``table`` most frequent words travel to the tasks. Counts of the rest meet the
documents' rare words in a join, summed per task and document before.

Edge cases: null and empty texts have the end alone; repeated rows are scored one by one; a null
id is not in the training part; without training text every word is unseen and scores come from the
untrained weights; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value, hold, released
from clusterloom.llm.words import Slice, word_slices

by_value(__name__)

HEAD, CLASS_WORDS, TABLE = 512, 32, 1 << 18
HIDDEN, WINDOW, LANES = 16, 24, 384
SHAPES = 48
#: Parts of the training texts, in sixteenths, that the rounds read.
ROUNDS = (1, 5, 10)
RATE = 0.02
#: Training tokens of one task.
SLICE_TOKENS = 1500000
END = np.uint64(0x5851F42D4C957F2D)
SLICE = 1 << 21


def shape_of(s: Slice) -> np.ndarray:
    """Shape class of each word: its last byte, and whether it has bytes above 127."""
    if not len(s.end):
        return np.zeros(0, np.int64)
    last = s.data[s.end - 1].astype(np.int64)
    wide = np.concatenate([[0], np.cumsum(s.data > 127)])
    plain = wide[s.end] == wide[s.start]
    return np.where(plain, last % (SHAPES - 16), SHAPES - 16 + last % 16)


@dataclass
class Words:
    """The vocabulary's part that every task holds."""

    hashes: np.ndarray  # ascending
    counts: np.ndarray
    slot: np.ndarray  # place in the head, or -1
    mass: np.ndarray  # of each shape class, with the slot of unseen words
    head_counts: np.ndarray
    total: int  # training tokens
    distinct: int
    ends: int


@dataclass
class Batch:
    """Tokens of a slice, ends included, in order of rows."""

    offsets: np.ndarray
    cls: np.ndarray
    slot: np.ndarray  # within the class, -1 for rare words
    count: np.ndarray  # -1 where the table does not say
    hash: np.ndarray


def tokens(s: Slice, h: np.ndarray, w: Words) -> Batch:
    n = s.last - s.first
    sizes = np.diff(s.word_offsets)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    place = np.arange(len(h)) + s.row_of_word()
    cls, slot = (np.empty(offsets[-1], np.int16) for _ in range(2))
    count = np.empty(offsets[-1], np.int64)
    full = np.empty(offsets[-1], np.uint64)
    ends = offsets[1:] - 1
    heads = len(w.head_counts)
    classes = -(-heads // CLASS_WORDS)
    at = np.zeros(len(h), np.int64)
    if len(w.hashes):  # a sorted search runs through the table once
        order = np.argsort(h)
        at[order] = np.minimum(np.searchsorted(w.hashes, h[order]), len(w.hashes) - 1)
    known = w.hashes[at] == h if len(w.hashes) else np.zeros(len(h), bool)
    rank = np.where(known, w.slot[at] if len(w.hashes) else -1, -1)
    cls[place] = np.where(rank >= 0, rank // CLASS_WORDS, classes + 1 + shape_of(s))
    slot[place] = np.where(rank >= 0, rank % CLASS_WORDS, -1)
    count[place] = np.where(known, w.counts[at] if len(w.hashes) else 0, -1)
    full[place] = h
    cls[ends], slot[ends], count[ends], full[ends] = classes, -1, w.ends, END
    return Batch(offsets, cls, slot, count, full)


def start_weights(w: Words, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; biases are log shares, so training starts from the word counts."""
    rng = np.random.default_rng(seed)
    heads = len(w.head_counts)
    classes = -(-heads // CLASS_WORDS)
    inputs = classes * CLASS_WORDS + 1 + SHAPES
    outputs = classes + 1 + SHAPES
    padded = np.zeros(classes * CLASS_WORDS)
    padded[:heads] = w.head_counts + 1.0
    mass = np.concatenate([padded.reshape(-1, CLASS_WORDS).sum(axis=1), [w.ends + 1.0], w.mass])
    inner = np.full(classes * CLASS_WORDS, -30.0)
    inner[:heads] = np.log(padded[:heads])
    inner = inner.reshape(-1, CLASS_WORDS)
    inner -= np.log(np.exp(inner).sum(axis=1, keepdims=True)) if classes else 0
    g = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    return {
        "embed": g(inputs, 3 * HIDDEN), "recur": g(HIDDEN, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32),
        "class": g(HIDDEN, outputs), "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "inner": g(classes, HIDDEN, CLASS_WORDS) * 0.1, "inner_bias": inner.astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def _step(x: np.ndarray, a: np.ndarray, h: np.ndarray, out: np.ndarray):
    """One step of the gated unit into ``out``; ``x`` (the input's part) becomes gates and candidate.

    Columns are lanes, so gates and candidate are contiguous.
    """
    k = HIDDEN
    gate, c = x[:2 * k], x[2 * k:]
    gate += a[:2 * k]
    _sigmoid(gate)
    z, r = gate[:k], gate[k:]
    c += r * a[2 * k:]
    np.tanh(c, c)
    np.subtract(c, h, out)
    out *= z
    out += h
    return z, r, c


def _inputs(p: dict, ids: np.ndarray) -> np.ndarray:
    """The inputs' parts of all gates: steps x gates x lanes."""
    return np.ascontiguousarray((p["embed"] + p["bias"])[ids].transpose(0, 2, 1))


def _rows(states: np.ndarray) -> np.ndarray:
    """States as rows, step after step."""
    return states.transpose(0, 2, 1).reshape(-1, HIDDEN)


def forward(p: dict, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """States (steps x units x lanes) of ``ids`` from ``h``: that *before* each token, and the last."""
    steps, lanes = ids.shape
    states = np.empty((steps + 1, HIDDEN, lanes), np.float32)
    states[0] = h
    x, recur = _inputs(p, ids), np.ascontiguousarray(p["recur"].T)
    for i in range(steps):
        _step(x[i], recur @ states[i], states[i], states[i + 1])
    return states


def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits, in place, and their sums; logits beyond +-80 are cut there."""
    np.clip(x, -80, 80, out=x)
    np.exp(x, x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def outputs(p: dict, state: np.ndarray, cls: np.ndarray, slot: np.ndarray, grads: dict | None):
    """Natural log probability of each token's class and place in it; adds gradients if asked."""
    at = np.arange(len(cls))
    e, total = shares(state @ p["class"] + p["class_bias"])
    value = np.log(e[at, cls] / total).astype(np.float64)
    back = None
    if grads is not None:
        e *= (-1 / total)[:, None]
        e[at, cls] += 1
        grads["class"] += state.T @ e
        grads["class_bias"] += e.sum(axis=0)
        back = e @ p["class"].T
    head = np.flatnonzero(slot >= 0)
    if len(head):
        head = head[np.argsort(cls[head].astype(np.int16), kind="stable")]
        cut = np.append(np.flatnonzero(np.append(True, np.diff(cls[head]) > 0)), len(head))
        states, places = state[head], slot[head]
        for a, b in zip(cut[:-1], cut[1:]):
            rows = head[a:b]
            c = cls[rows[0]]
            s = states[a:b]
            e, total = shares(s @ p["inner"][c] + p["inner_bias"][c])
            each = np.arange(b - a)
            value[rows] += np.log(e[each, places[a:b]] / total)
            if grads is not None:
                e *= (-1 / total)[:, None]
                e[each, places[a:b]] += 1
                grads["inner"][c] += s.T @ e
                grads["inner_bias"][c] += e.sum(axis=0)
                back[rows] += e @ p["inner"][c].T
    return value, back


def input_ids(cls: np.ndarray, slot: np.ndarray, heads: int) -> np.ndarray:
    classes = -(-heads // CLASS_WORDS)
    return np.where(slot >= 0, cls * CLASS_WORDS + slot, classes * CLASS_WORDS + cls - classes)


def score_rows(p: dict, cls: np.ndarray, slot: np.ndarray, sizes: np.ndarray, heads: int, window: int = 64) -> np.ndarray:
    """Natural log of class and place of all tokens of every row, in one pass over the texts.

    Rows run side by side; the state is carried from window to window until a row ends.
    """
    n = len(sizes)
    ids = input_ids(cls, slot, heads)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    out = np.zeros(n)
    h = np.zeros((HIDDEN, n), np.float32)
    at, live = 0, n
    while live:
        step = int(min(window, max(1, sizes[:live].max() - at)))
        where = begin[:live] + at + np.arange(step)[:, None]
        inside = at + np.arange(step)[:, None] < sizes[:live]
        where = np.where(inside, where, 0)
        states = forward(p, ids[where], h[:, :live])
        flat = np.flatnonzero(inside.ravel())
        before = _rows(states[:-1])
        place = where.ravel()
        for a in range(0, len(flat), 1 << 16):
            some = flat[a:a + (1 << 16)]
            value, _ = outputs(p, before[some], cls[place[some]], slot[place[some]], None)
            out[order[:live]] += np.bincount(some % live, value, live)
        h[:, :live] = states[-1]
        at += step
        live = int(np.searchsorted(-sizes, -at, "left"))
    return out


def train_slice(p: dict, b: Batch, heads: int, squares: dict, rate: float) -> None:
    """One pass of truncated backpropagation over a slice's tokens, dealt to lanes in order."""
    ids = input_ids(b.cls, b.slot, heads)
    lanes = int(min(LANES, max(1, len(ids) // WINDOW)))
    length = -(-len(ids) // lanes)
    grid = np.arange(length)[:, None] + np.arange(lanes) * length
    starts = np.zeros(len(ids), bool)
    starts[b.offsets[:-1]] = True
    h = np.zeros((HIDDEN, lanes), np.float32)
    for a in range(0, length, WINDOW):
        where = grid[a:a + WINDOW]
        live = None
        if where[-1, -1] >= len(ids):  # the last lanes are padded
            live = where < len(ids)
            where = np.where(live, where, 0)
        h = np.where(starts[where[0]], np.float32(0), h)
        h = _train_window(p, ids[where], b.cls[where], b.slot[where], starts[where], h, squares, rate, live)


def _train_window(p, ids, cls, slot, starts, h, squares, rate, live=None):
    k = HIDDEN
    steps, lanes = ids.shape
    # A text that begins inside the window forgets the one before: its state is zeroed.
    states = np.empty((steps + 1, k, lanes), np.float32)
    states[0] = h
    x, recur = _inputs(p, ids), np.ascontiguousarray(p["recur"].T)
    trace = []
    for i in range(steps):
        if starts[i].any():
            states[i][:, starts[i]] = 0
        a = recur @ states[i]
        trace.append((*_step(x[i], a, states[i], states[i + 1]), a[2 * k:]))
    grads = {name: np.zeros_like(v) for name, v in p.items()}
    rows = _rows(states[:-1])
    if live is None:
        count = ids.size
        _, back = outputs(p, rows, cls.ravel(), slot.ravel(), grads)
    else:
        kept = np.flatnonzero(live.ravel())
        count = len(kept)
        _, held = outputs(p, rows[kept], cls.ravel()[kept], slot.ravel()[kept], grads)
        back = np.zeros((ids.size, k), np.float32)
        back[kept] = held
    back = np.ascontiguousarray(back.reshape(steps, lanes, k).transpose(0, 2, 1))
    d = np.zeros((k, lanes), np.float32)
    dx = np.empty((steps, 3 * k, lanes), np.float32)
    da = np.empty((3 * k, lanes), np.float32)
    for i in range(steps - 1, -1, -1):
        z, r, c, ac = trace[i]
        dz, dr, dc = dx[i, :k], dx[i, k:2 * k], dx[i, 2 * k:]
        np.subtract(c, states[i], dz)
        dz *= z
        dz *= 1 - z
        dz *= d
        np.multiply(d, z, dc)
        c *= c
        dc -= dc * c
        np.multiply(dc, r, da[2 * k:])
        np.multiply(da[2 * k:], ac, dr)
        dr *= 1 - r
        da[:2 * k] = dx[i, :2 * k]
        grads["recur"] += states[i] @ da.T
        d *= 1 - z
        d += p["recur"] @ da
        d += back[i]
        if starts[i].any():
            d[:, starts[i]] = 0
    dx = dx.transpose(0, 2, 1)
    flat = dx.reshape(-1, 3 * k)
    grads["bias"] += flat.sum(axis=0)
    order = np.argsort(ids.ravel().astype(np.int16), kind="stable")
    sorted_ids = ids.ravel()[order]
    cut = np.flatnonzero(np.append(True, np.diff(sorted_ids) > 0))
    touched = sorted_ids[cut]
    grads.pop("embed")
    part = np.add.reduceat(flat[order], cut, axis=0) / count
    squares["embed"][touched] += part * part
    p["embed"][touched] += rate * part / np.sqrt(squares["embed"][touched])
    for name, g in grads.items():
        g = g / count
        squares[name] += g * g
        p[name] += rate * g / np.sqrt(squares[name])
    return states[-1]


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(like: dict, flat: np.ndarray) -> dict:
    out, at = {}, 0
    for name, v in like.items():
        out[name] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """``(hash, shape, c)`` of the words of a text column; the end has a hash of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged():
            h, shape, c = (np.concatenate(x) for x in zip(*held))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, shape[first], np.bincount(inverse, c, len(u)).astype(np.int64)

        def flush():
            u, shape, c = merged()
            for i in range(0, len(u), 100000):
                part = slice(i, i + 100000)
                yield pa.RecordBatch.from_arrays([pa.array(u[part].view(np.int64)), pa.array(shape[part].astype(np.int32)), pa.array(c[part])], ["hash", "shape", "c"])

        for batch in batches:
            for s, h in word_slices(batch.column(0), SLICE):
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((np.append(u, END), np.append(shape_of(s)[first], -1), np.append(c, s.last - s.first)))
                size += len(u)
                if size > 1 << 20:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from flush()
                        held.clear()
                        size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(released(run), "hash long, shape int, c long").groupBy("hash").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int, table: int) -> Words:
    """The ``table`` most frequent words and the classes' totals; both are bounded by parameters."""
    end = int(np.int64(END.view(np.int64)))
    sums = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("hash") == end, F.col("c")))).first()
    words = counts.filter(F.col("hash") != end)
    top = words.orderBy(F.desc("c"), "hash").limit(table).toArrow()
    h = top["hash"].to_numpy().view(np.uint64)
    c = top["c"].to_numpy().astype(np.int64)
    heads = min(head, len(h))
    mass = np.ones(SHAPES)
    for r in words.groupBy("shape").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["shape"]] += r["m"]
    np.subtract.at(mass, top["shape"].to_numpy()[:heads], c[:heads] + 1)
    order = np.argsort(h)
    slot = np.where(order < heads, order, -1)
    return Words(h[order], c[order], slot, mass, c[:heads].copy(), int(sums[0] or 0), int(sums[1] or 0), int(sums[2] or 0))


def fit(docs: DataFrame, w: Words, rounds=ROUNDS, rate: float = RATE) -> dict:
    """Average the tasks' weights after each round; ``docs`` are the training texts."""
    p = start_weights(w)
    heads = len(w.head_counts)
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(sum(rounds)))
    begin = 0
    squares0 = None
    for width in rounds:
        given, gradients = p, squares0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {k: v.copy() for k, v in given.items()}
            squares = {k: v.copy() for k, v in gradients.items()} if gradients else {k: np.full(v.shape, 1e-6, np.float32) for k, v in own.items()}
            seen = 0
            for batch in batches:
                for s, h in word_slices(batch.column(0), SLICE):
                    b = tokens(s, h, w)
                    train_slice(own, b, heads, squares, rate)
                    seen += len(b.cls)
            if seen:
                both = np.concatenate([_flat(own), _flat(squares)]).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array([both.astype(np.float32).tobytes()], pa.binary()), pa.array([float(seen)])], ["weights", "n"])

        # Slices and their order depend on the texts alone, not on how the table is split.
        slices = max(1, math.ceil(w.total * width / sum(rounds) / SLICE_TOKENS))
        chosen = docs.filter((part >= begin) & (part < begin + width)).select("text").repartition(
            slices, F.xxhash64("text", F.lit(6))).sortWithinPartitions(F.xxhash64("text", F.lit(7)))
        begin += width
        total = _sum_tree(chosen.mapInArrow(released(run), "weights binary, n double"))
        if total is not None:
            flat, n = total
            half = len(flat) // 2
            p, squares0 = _shaped(p, flat[:half] / n), _shaped(p, flat[half:] / n)
    return p


def _sum_tree(parts: DataFrame) -> tuple[np.ndarray, float] | None:
    """Sum of all tasks' weights, in a tree of bounded width; one row reaches the driver."""
    rows = parts.rdd.map(lambda r: (np.frombuffer(r[0], np.float32).astype(np.float64), r[1]))
    return rows.treeAggregate(
        None, lambda a, b: b if a is None else (a[0] + b[0], a[1] + b[1]),
        lambda a, b: a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1]), depth=3)


def score(docs: DataFrame, w: Words, p: dict, counts: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of every row."""
    heads = len(w.head_counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    log_mass = np.log10(w.mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = -(-heads // CLASS_WORDS)
        for batch in batches:
            parts, cls, slot, sizes = [], [], [], []
            for s, h in word_slices(batch.column(1), SLICE):
                b = tokens(s, h, w)
                n = s.last - s.first
                row = np.repeat(np.arange(n), np.diff(b.offsets))
                cls.append(b.cls)
                slot.append(b.slot)
                sizes.append(np.diff(b.offsets))
                inner = np.zeros(n)
                rare = b.cls > classes
                inner -= np.bincount(row[rare], log_mass[b.cls[rare] - classes - 1], n)
                told = b.count >= 0
                logs = np.where(told, np.log10(np.maximum(b.count, 0) + 1.0), 0.0)
                listed = rare & told
                inner += np.bincount(row[listed], logs[listed], n)
                base = np.bincount(row, logs, n)
                known = np.bincount(row, told & (b.count > 0), n).astype(np.int64)
                # Words the table lacks: one entry for each word of a row.
                rest = np.flatnonzero(~told)
                order = np.lexsort((b.hash[rest], row[rest]))
                rest = rest[order]
                new = np.append(True, (row[rest][1:] != row[rest][:-1]) | (b.hash[rest][1:] != b.hash[rest][:-1])) if len(rest) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rest))).astype(np.int32)
                words = b.hash[rest[first]].view(np.int64)
                cut = np.searchsorted(row[rest[first]], np.arange(n + 1))
                parts.append([
                    batch.column(0).slice(s.first, n), pa.array(np.diff(b.offsets)), pa.array(known), pa.array(base), inner,
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(words)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times)),
                ])
            if parts:  # all rows of the batch at once: long texts share their steps
                logs = score_rows(p, np.concatenate(cls), np.concatenate(slot), np.concatenate(sizes), heads) / np.log(10)
                at = 0
                for x in parts:
                    x[4] = pa.array(x[4] + logs[at:at + len(x[4])])
                    at += len(x[4])
                    yield pa.RecordBatch.from_arrays(x, ["doc_id", "n_tokens", "known", "base", "inner", "rare", "times"])

    rows = hold(docs.select("doc_id", "text").mapInArrow(
        released(run), f"doc_id {kind}, n_tokens long, known long, base double, inner double, rare array<long>, times array<int>"
    ).withColumn("_row", F.monotonically_increasing_id()))
    rare = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("_row", F.col("z.rare").alias("hash"), F.col("z.times").alias("t"))
    found = rare.join(counts.select("hash", "c"), "hash").groupBy("_row").agg(
        F.sum("t").alias("k"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("g"))
    norm = float(np.log10(w.total + (w.distinct + 1)))
    more = F.coalesce("g", F.lit(0.0))
    return rows.drop("rare", "times").join(found, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("inner") + more).alias("score"))


def score_documents(docs: DataFrame, training: Column, *, head: int = HEAD, table: int = TABLE) -> tuple[DataFrame, int]:
    """Train on the rows of ``training``, score all; also the number of training tokens."""
    chosen = docs.filter(training).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = hold(count_words(chosen))
    w = vocabulary(counts, head, table)
    p = fit(chosen, w) if w.total else start_weights(w)
    return score(docs, w, p, counts), w.total
