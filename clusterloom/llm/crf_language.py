"""Language of words and documents by a linear-chain conditional random field (operator 3).

Words are runs of letters. A word's emission adds the weights of its character bigrams and
trigrams (word edges included, so they carry one- and two-letter affixes), of its three-letter
prefix and suffix, and of its entry in a learned lexicon. Transitions are learned too. Labels of
all words follow by forward-backward; a document's language has the largest mean marginal.

Fitting uses a bounded sample (``sample_rows`` documents by hash order and ``windows`` windows of
``window_words`` words of each); pairs of windows of different languages are joined, so the
model sees switches. Scoring reads every word of every text. Long documents are handled as blocks
of words: each block's transfer matrix is computed side by side, the blocks are chained, and then
every block is scanned with its exact incoming messages.

Edge cases: a null text or one without a letter gets ``und`` with score 0; without any labelled
row every text is ``und``; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value, fenced, released, small_batches
from clusterloom.llm.words import Slice, hash_words, split, text_slices

by_value(__name__)

SAMPLE_ROWS, WINDOWS, WINDOW_WORDS = 2000, 4, 40
AFFIX_BITS, LEXICON_BITS = 15, 17
BLOCK_WORDS = 64
#: Weights are gathered for each byte, so slices are smaller than elsewhere.
SLICE_BYTES = 1 << 19
UND = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gap() -> np.ndarray:
    gap = np.ones(256, bool)
    gap[97:123] = False
    gap[128:] = False
    return gap


@dataclass
class Model:
    labels: list[str]
    bigram: np.ndarray  # 2^16 x labels
    trigram: np.ndarray
    prefix: np.ndarray  # 2^AFFIX_BITS x labels
    suffix: np.ndarray
    lexicon: np.ndarray  # 2^LEXICON_BITS x labels
    known: np.ndarray  # hash of the lexicon's word in each place, 0 if none
    transition: np.ndarray  # labels x labels


@dataclass
class Features:
    """Indices into the weight tables; n-grams are per byte, ``word`` cuts them into words."""

    bigram: np.ndarray
    trigram: np.ndarray
    first: np.ndarray  # where a word's n-grams begin
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    hash: np.ndarray


def letter_words(column: pa.Array) -> Iterator[Slice]:
    gap = _gap()
    for first, last, data, offsets in text_slices(pc.utf8_lower(column), SLICE_BYTES):
        yield split(first, last, data, offsets, gap)


def features(s: Slice) -> Features:
    """N-grams end at each byte of a word and at the gap after it."""
    gap = _gap()
    data = np.where(gap[s.data], np.uint8(32), s.data)
    n = len(data)
    padded = np.full(n + 3, 32, np.uint16)
    padded[2:n + 2] = data
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, s.start, 1)
    np.add.at(inside, s.end, -1)
    inside = np.cumsum(inside) > 0
    edge = inside.copy()  # the words' bytes and one more
    edge[s.end] = True
    at = np.flatnonzero(edge)
    # A word that begins right where a text ends has a gap before it, whatever byte stands there.
    two, three = padded[at + 1].copy(), padded[at].copy()
    one = padded[at + 2].copy()
    first = np.searchsorted(at, s.start)
    two[first] = 32
    three[first] = 32
    single = first + 1
    three[single] = 32
    bi = (two << np.uint16(8)) | one
    tri = ((three.astype(np.uint64) << np.uint64(16)) | (two.astype(np.uint64) << np.uint64(8)) | one) * _ODD
    m = len(s.start)
    key = np.zeros((2, m), np.uint64)
    size = s.end - s.start
    for i in range(3):
        ok = size > i
        key[0, ok] = key[0, ok] * np.uint64(257) + data[s.start[ok] + i] + np.uint64(1)
        key[1, ok] = key[1, ok] * np.uint64(257) + data[s.end[ok] - 1 - i] + np.uint64(1)
    affix = ((key * _ODD) >> np.uint64(64 - AFFIX_BITS)).astype(np.int64)
    h = hash_words(s, data)
    return Features(bi, (tri >> np.uint64(48)).astype(np.uint16), first, affix[0], affix[1],
                    (h >> np.uint64(64 - LEXICON_BITS)).astype(np.int64), h)


def emissions(f: Features, m: Model) -> np.ndarray:
    if not len(f.first):
        return np.zeros((0, len(m.labels)), np.float32)
    grams = m.bigram[f.bigram] + m.trigram[f.trigram]
    out = np.add.reduceat(grams, f.first, axis=0)
    out += m.prefix[f.prefix] + m.suffix[f.suffix]
    hit = m.known[f.lexicon] == f.hash
    out[hit] += m.lexicon[f.lexicon[hit]]
    return out


def _normal(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(
    emission: np.ndarray, offsets: np.ndarray, transition: np.ndarray, block: int = BLOCK_WORDS, messages: bool = False
):
    """Posterior of every word's label; ``offsets`` cut the words into documents.

    With ``messages`` also the forward message of each word and its emission times the backward
    message, from which the posteriors of neighbouring pairs follow.

    Exact forward-backward. Lanes are blocks of ``block`` words, so a long document costs no
    more steps than a short one but for one step per block.
    """
    total, k = emission.shape
    if not total:
        return emission.astype(np.float64)
    sizes = np.diff(offsets)
    blocks = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), blocks)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = offsets[:-1][doc] + rank * block
    length = np.minimum(block, offsets[1:][doc] - begin)
    where = begin[:, None] + np.arange(block)
    live = np.arange(block) < length[:, None]
    where = np.where(live, where, 0)
    # The exponent's range is bounded before exponentiation.
    e = np.exp(np.clip(emission - emission.max(axis=1, keepdims=True), -60, 0)).astype(np.float64)[where]
    t = np.exp(transition.astype(np.float64) - transition.max())
    n = len(doc)
    first_of_doc = rank == 0

    carry = np.broadcast_to(np.eye(k), (n, k, k)).copy()  # message in -> message out, a row each
    for i in range(block):
        moved = carry @ t
        if i == 0:
            moved[first_of_doc] = 1.0  # the first word has no word before it
        step = _normal(moved * e[:, i, None, :], (1, 2))
        carry = np.where(live[:, i, None, None], step, carry)
    fore = np.full((n, k), 1.0 / k)
    back = np.full((n, k), 1.0 / k)
    deepest = int(blocks.max(initial=0))
    head = np.cumsum(blocks) - blocks
    for r in range(1, deepest):
        at = head[blocks > r] + r
        fore[at] = _normal(np.einsum("ni,nij->nj", fore[at - 1], carry[at - 1]), 1)
    for r in range(deepest - 2, -1, -1):
        at = head[blocks > r + 1] + r
        back[at] = _normal(np.einsum("nij,nj->ni", carry[at + 1], back[at + 1]), 1)

    alpha = np.empty((n, block, k))
    message = fore
    for i in range(block):
        moved = message @ t
        if i == 0:
            moved[first_of_doc] = 1.0
        message = np.where(live[:, i, None], _normal(moved * e[:, i], 1), message)
        alpha[:, i] = message
    later = np.empty((n, block, k))
    message = back
    for i in range(block - 1, -1, -1):
        later[:, i] = message
        message = np.where(live[:, i, None], _normal((message * e[:, i]) @ t.T, 1), message)
    posterior = _normal(np.maximum(alpha[live] * later[live], 1e-300), 1)  # blocks are in word order
    return (posterior, alpha[live], later[live] * e[live]) if messages else posterior


def fit(frame: pd.DataFrame, labels: list[str], *, epochs: int = 4, batch: int = 128, rate: float = 0.15, seed: int = 7) -> Model:
    """Stochastic gradient of the conditional likelihood over sampled windows ``(text, lang)``."""
    k = len(labels)
    rng = np.random.default_rng(seed)
    m = Model(labels, *(np.zeros((1 << b, k), np.float32) for b in (16, 16, AFFIX_BITS, AFFIX_BITS, LEXICON_BITS)),
              np.zeros(1 << LEXICON_BITS, np.uint64), np.zeros((k, k), np.float32))
    code = frame["lang"].map({x: i for i, x in enumerate(labels)}).to_numpy()
    texts = frame["text"].to_numpy()
    # Windows of any two languages follow one another, so that switches occur.
    order = rng.permutation(len(texts))
    pairs = [order[i:i + 2] for i in range(0, len(order), 2)]
    words = [s for s in letter_words(pa.array(list(texts), pa.large_string()))]
    hashes = np.concatenate([features(s).hash for s in words]) if words else np.zeros(0, np.uint64)
    seen, counts = np.unique(hashes, return_counts=True)
    frequent = counts >= 3
    for h in seen[frequent][np.argsort(counts[frequent], kind="stable")]:  # the most frequent stay
        m.known[int(h >> np.uint64(64 - LEXICON_BITS))] = h
    tables = ("bigram", "trigram", "prefix", "suffix", "lexicon", "transition")
    squares = {t: np.full(getattr(m, t).shape, 1e-2, np.float32) for t in tables}
    for _ in range(epochs):
        rng.shuffle(pairs)
        for at in range(0, len(pairs), batch):
            chosen = pairs[at:at + batch]
            joined = [" ".join(texts[i] for i in p) for p in chosen]
            for s in letter_words(pa.array(joined, pa.large_string())):
                _step(s, [chosen[i] for i in range(s.first, s.last)], texts, code, m, squares, rate)
    return m


def _step(s: Slice, chosen, texts, code, m: Model, squares, rate: float) -> None:
    k = len(m.labels)
    f = features(s)
    if not len(f.hash):
        return
    # The label of a word is that of the window its bytes stand in.
    gold = np.empty(len(f.hash), np.int64)
    for row, parts in enumerate(chosen):
        a, b = s.word_offsets[row], s.word_offsets[row + 1]
        cut = s.offsets[row] + len(texts[parts[0]].lower().encode())
        gold[a:b] = np.where(s.start[a:b] <= cut, code[parts[0]], code[parts[-1]])
    e = emissions(f, m)
    p, fore, later = marginals(e, s.word_offsets, m.transition, messages=True)
    delta = -p
    delta[np.arange(len(gold)), gold] += 1
    inner = np.ones(len(gold), bool)
    inner[s.word_offsets[:-1][np.diff(s.word_offsets) > 0]] = False
    at = np.flatnonzero(inner)
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[at - 1], gold[at]), 1)
    joint = fore[at - 1][:, :, None] * np.exp(m.transition)[None] * later[at][:, None, :]
    expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    grads = {"transition": (observed - expected) / max(1, len(at))}
    spread = np.repeat(np.arange(len(gold)), np.diff(np.append(f.first, len(f.bigram))))
    hit = np.flatnonzero(m.known[f.lexicon] == f.hash)
    for name, index, rows in (("bigram", f.bigram, spread), ("trigram", f.trigram, spread), ("prefix", f.prefix, slice(None)),
                              ("suffix", f.suffix, slice(None)), ("lexicon", f.lexicon[hit], hit)):
        shape = getattr(m, name).shape
        d = delta[rows]
        grads[name] = np.stack([np.bincount(index, d[:, j], shape[0]) for j in range(k)], 1) / len(gold)
    for name, g in grads.items():
        g = g.astype(np.float32) - 1e-6 * getattr(m, name)
        squares[name] += g * g
        getattr(m, name)[...] += rate * g / np.sqrt(squares[name])


def sample(docs: DataFrame, train: Column, *, rows: int, windows: int, window_words: int, seed: int = 11) -> pd.DataFrame:
    """At most ``rows * windows`` windows ``(text, lang)`` of labelled rows, by hash order."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, lang, h in zip(f["text"], f["lang"], f["_h"]):
                rng = np.random.default_rng(abs(int(h)))
                for _ in range(windows):
                    # Windows start anywhere in the whole text.
                    a = int(rng.integers(0, max(1, len(text) - 6 * window_words)))
                    part = text[a:a + 12 * window_words].split()[:window_words]
                    if part:
                        out.append((" ".join(part), lang))
            yield pd.DataFrame(out, columns=["text", "lang"])

    chosen = (
        docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", "lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h"), "text")
    )
    # Row hashes are narrow, so the cut by hash moves no text.
    cut_at = chosen.select("_h").orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
    if cut_at is None:
        return pd.DataFrame({"text": [], "lang": []})
    few = chosen.filter(F.col("_h") <= cut_at).dropDuplicates(["_h"])
    return few.select("text", "lang", "_h").mapInPandas(cut, "text string, lang string").toPandas()


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, lang_pred, score, n_words)``."""
    return judge(docs.select("doc_id", "text"), model).select(
        "doc_id", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_words").alias("n_words"))


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns with ``lang_pred``, ``lang_score`` and ``lang_words``, which replace
    columns of these names."""
    added = ("lang_pred", "lang_score", "lang_words")
    names = [c for c in docs.columns if c not in added]
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2048):
            n = batch.num_rows
            best, score, size = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            for s in letter_words(batch.column(at)) if model is not None else ():
                p = marginals(emissions(features(s), model), s.word_offsets, model.transition)
                sums = np.vstack([np.zeros(len(model.labels)), np.cumsum(p, axis=0)])
                m = np.diff(s.word_offsets)
                mean = (sums[s.word_offsets[1:]] - sums[s.word_offsets[:-1]]) / np.maximum(m, 1)[:, None]
                rows = slice(s.first, s.last)
                best[rows] = np.where(m > 0, mean.argmax(axis=1), -1)
                score[rows] = np.clip(mean.max(axis=1), 0, 1)
                size[rows] = m
                # Bytes above 127 are taken for letters; a text that has no others may hold none.
                latin = np.concatenate([[0], np.cumsum((s.data >= 97) & (s.data < 123))])[s.offsets]
                for i in np.flatnonzero((m > 0) & (np.diff(latin) == 0)):
                    text = batch.column(at)[s.first + i].as_py()
                    if not any(c.isalpha() for c in text):
                        best[s.first + i], score[s.first + i] = -1, 0.0
            found = [model.labels[b] if b >= 0 else UND for b in best] if model is not None else [UND] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(np.where(best >= 0, score, 0.0)), pa.array(size)], [*names, *added])

    return docs.select(*names).mapInArrow(released(run), schema + ", lang_pred string, lang_score double, lang_words long")


def accept(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows whose text is in a learned language with a mean probability of ``least`` or more,
    all columns as they were, whatever their names."""
    apart, back = fenced(docs, "doc_id", "text", "lang")
    judged = judge(apart, model)
    return back(judged.filter((F.col("lang_pred") != UND) & (F.col("lang_score") >= least)))


def train(
    docs: DataFrame, where: Column, *, sample_rows: int = SAMPLE_ROWS, windows: int = WINDOWS, window_words: int = WINDOW_WORDS
) -> Model | None:
    frame = sample(docs, where, rows=sample_rows, windows=windows, window_words=window_words)
    labels = sorted(frame["lang"].unique())
    return fit(frame.sort_values(["text", "lang"], ignore_index=True), labels) if labels else None
