"""Hard negatives by the threshold algorithm over blocks of candidates (operator 11).

Vectors become integers, ``floor(256 * x)``; a score is an integer inner product. All rows are cut
into blocks of bounded size. A block holds, for every dimension, the list of its rows sorted by
that component. An anchor reads each list from the end that its own component's sign favours, all
to the same depth; rows that it meets for the first time are scored at once by their whole vectors.
What an unseen row can reach at most is the sum of the anchor's components times the values last
read. Reading stops once that is strictly below the score of the last row each window has room
for (or, while a window is not full, strictly below the least score it takes).

Two rounds use it: one window over rows of the anchor's own label finds the positives, then one
window per positive over rows of other labels finds its negatives. The first few of each block
meet in one ranking per anchor, which is exact as every block's are. Anchors go to all blocks in
packs; no pairs are formed beyond the rows a window keeps.

Edge cases: rows with a null id, a null label, a null vector or a null or non-finite component
take no part; nor do rows whose scores could leave 64 bits. Shorter vectors end in zeros, an empty
vector is zero. Equal rows count once; rows of one id with other contents are rows of their own,
but never each other's positives. Ties go to the smaller id. Windows of negative positives are
empty. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value, hold

by_value(__name__)

#: Rows of a candidate block on average (distinct rows are dealt by hash), and anchors of a pack.
BLOCK, PACK = 2048, 256
SCALE = 256


def scaled(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """Distinct ``(id, label, v)`` of the rows that take part, ``v`` as whole numbers."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = rows.filter(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.col(vector).alias("x"))
    wide = F.expr("aggregate(x, 0D, (a, b) -> greatest(a, abs(CAST(b AS DOUBLE))))")
    # 64-bit sums: the square of the largest component times the length stays under 2 ** 62.
    fits = (wide * SCALE + 1) * F.sqrt(F.greatest(F.size("x"), F.lit(1)).cast("double")) < float(1 << 31)
    return out.filter(fits).select("id", "label", "v").distinct()


def _pack(batches: Iterator[pa.RecordBatch], rows: int | None, dims: int) -> Iterator[tuple]:
    """Packs of one block's rows (at most ``rows`` where given): block, ids, labels, matrix."""
    parts, size, now = [], 0, None
    for batch in batches:
        where = batch.column(0).to_numpy()
        ids, labels = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        lists = batch.column(3)
        ends = np.asarray(lists.offsets)
        length = np.diff(ends)
        mat = np.zeros((batch.num_rows, dims), np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
        mat[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], length)] = flat
        begin = 0
        while begin < batch.num_rows:
            if where[begin] != now or size == rows:
                if parts:
                    yield (now, *(np.concatenate(x) for x in zip(*parts)))
                parts, size, now = [], 0, where[begin]
            end = int(np.searchsorted(where, now, "right"))
            if rows is not None:
                end = min(end, begin + rows - size)
            parts.append((ids[begin:end], labels[begin:end], mat[begin:end]))
            size += end - begin
            begin = end
    if parts:
        yield (now, *(np.concatenate(x) for x in zip(*parts)))


_PACKED = "block long, n long, ids binary, labels binary, vectors binary"


def _packed(rows: DataFrame, size: int | None, blocks: int, dims: int) -> DataFrame:
    """Rows dealt evenly to ``blocks`` blocks, each packed whole or in packs of ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels, mat in _pack(batches, size, dims):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, mat)]],
                ["block", "n", "ids", "labels", "vectors"])

    dealt = rows.select(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).alias("block"), "id", "label", "v")
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", "id").mapInArrow(run, _PACKED)


class Lists:
    """A block's rows and, per dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, mat: np.ndarray) -> None:
        self.ids, self.labels, self.mat = ids, labels, mat
        self.small = mat.size == 0 or int(np.abs(mat).max()) < 1 << 22
        self.real = mat.astype(np.float64) if self.small else None
        self.order = np.argsort(mat, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(mat, self.order, 0)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole-number inner products; by doubles where those are exact."""
        if self.small and int(np.abs(anchor).max(initial=0)) < 1 << 22:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.mat[rows] @ anchor


def threshold(lists: Lists, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int | None, int | None]], k: int):
    """The first ``k`` rows of each window ``(least, most)``, by score, then id: lists of
    ``(scores, rows)``. ``fits`` are the rows that count; the second result is the depth read."""
    n, dims = lists.mat.shape
    used = np.flatnonzero(anchor)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
    seen = ~fits
    depth, step = 0, max(16, n // 32)
    while depth < n:
        upto = min(n, depth + step)
        met = np.zeros(n, bool)
        bound = 0
        if len(used):
            up = used[anchor[used] > 0]
            down = used[anchor[used] < 0]
            met[lists.order[n - upto:n - depth, up].ravel()] = True
            met[lists.order[depth:upto, down].ravel()] = True
            bound = int(lists.values[n - upto, up] @ anchor[up]) + int(lists.values[upto - 1, down] @ anchor[down])
        else:  # a zero anchor scores zero everywhere: every list is a tie
            met[:], upto = True, n
        new = np.flatnonzero(met & ~seen)
        seen |= met
        depth = upto
        if len(new):
            score = lists.scores(new, anchor)
            for w, (least, most) in enumerate(windows):
                inside = np.ones(len(new), bool)
                if least is not None:
                    inside &= score >= least
                if most is not None:
                    inside &= score <= most
                s, r = np.concatenate([best[w][0], score[inside]]), np.concatenate([best[w][1], new[inside]])
                first = np.lexsort((lists.ids[r], -s))[:k]
                best[w] = s[first], r[first]
        if all((len(s) >= k and bound < s[-1]) or (len(s) < k and least is not None and bound < least) for (s, _), (least, _) in zip(best, windows)):
            break
    return best, depth


def _search(candidates: DataFrame, anchors: DataFrame, blocks: int, dims: int, k: int, work: str) -> DataFrame:
    """Each anchor pack against each candidate pack. ``work`` is ``same``: one window over rows of
    the same label and another id; or ``other``: the windows of ``at_most`` over the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = at = None
        for batch in batches:
            for i in range(batch.num_rows):
                to, kind, ids, labels, mat, most = (batch.column(c)[i].as_py() for c in range(6))
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                mat = np.frombuffer(mat, np.int64).reshape(len(ids), dims)
                if kind == 0:
                    at, lists = to, Lists(ids, labels, mat)
                    continue
                if at != to:  # a block without rows
                    continue
                out = []
                for a in range(len(ids)):
                    if work == "same":
                        fits, windows = (lists.labels == labels[a]) & (lists.ids != ids[a]), [(None, None)]
                        names = [None]
                    else:
                        # From 80 % of the positive's score up to it; nothing below zero qualifies.
                        fits, names = lists.labels != labels[a], sorted({p for p in most[a] if p >= 0})
                        windows = [(-(-80 * p // 100), p) for p in names]
                    if not windows or not fits.any():
                        continue
                    best, _ = threshold(lists, mat[a], fits, windows, k)
                    for name, (s, r) in zip(names, best):
                        out.append((np.full(len(s), ids[a]), np.full(len(s), labels[a]), [name] * len(s), s, lists.ids[r], lists.labels[r],
                                    [mat[a].tobytes()] * len(s)))
                if out:
                    cols = [[x for part in c for x in part] for c in zip(*out)]
                    kinds = [pa.int64()] * 6 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                     ["anchor", "label", "most", "score", "id", "id_label", "key"])

    lists = candidates.select(F.col("block").alias("to"), F.lit(0).alias("kind"), "ids", "labels", "vectors",
                              F.lit(None).cast("array<array<long>>").alias("at_most"))
    # Every pack of anchors goes to every block of candidates, in one stream after its lists.
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = anchors.select(to.alias("to"), F.lit(1).alias("kind"), "ids", "labels", "vectors", "at_most")
    both = lists.unionByName(sent).repartition(2 * blocks, "to").sortWithinPartitions("to", "kind")
    return both.mapInArrow(run, "anchor long, label long, most long, score long, id long, id_label long, key binary")


def mine(
    rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100,
    positives: int = 5, negatives: int = 5, relabel_every: int = 7, labels: int = 10, block: int = BLOCK, pack: int = PACK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    new = F.when(F.col(id_col) % relabel_every == 0, (F.col(label).cast("long") + 1) % labels).otherwise(F.col(label).cast("long"))
    data = hold(scaled(rows.select(F.col(id_col).alias("_i"), F.col(vector).alias("_v"), new.alias("_l")), "_i", "_v", "_l"))
    total, dims = data.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 0)
    blocks = max(1, math.ceil(total / block))
    candidates = hold(_packed(data, None, blocks, dims))
    asked = data.filter(F.col("id") % every == 0)
    packs = max(1, math.ceil(total / every / pack))
    first = _packed(asked, pack, packs, dims).withColumn("at_most", F.lit(None).cast("array<array<long>>"))
    near = _search(candidates, first, blocks, dims, positives, "same")
    own = ["anchor", "label", "key"]
    chosen = near.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "id", "id_label"))).filter(
        F.col("_r") <= positives)
    chosen = hold(chosen.select(*own, F.col("id").alias("positive"), F.col("score").alias("top"), "_r"))
    windows = chosen.groupBy(*own).agg(F.sort_array(F.collect_set("top")).alias("tops"))
    again = _packed_anchors(hold(windows), pack, packs)
    hard = _search(candidates, again, blocks, dims, negatives, "other").select(*own, "most", F.col("id").alias("negative"), F.col("score").alias("low"), "id_label")
    ranked = hard.withColumn("rank", F.row_number().over(
        Window.partitionBy(*own, "most").orderBy(F.desc("low"), "negative", "id_label"))).filter(F.col("rank") <= negatives)
    return chosen.join(ranked.withColumnRenamed("most", "top"), [*own, "top"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"), F.col("top").alias("positive_score"), F.col("low").alias("negative_score"))


def _packed_anchors(windows: DataFrame, size: int, packs: int) -> DataFrame:
    """Anchors with their positives' scores, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()),
                     pa.array([b"".join(part.column(2).to_pylist())], pa.binary()), pa.array([part.column(3).to_pylist()], pa.list_(pa.list_(pa.int64())))],
                    ["ids", "labels", "vectors", "at_most"])

    spread = windows.repartition(packs, F.xxhash64("anchor", "label", "key"))
    return spread.select("anchor", "label", "key", "tops").mapInArrow(run, "ids binary, labels binary, vectors binary, at_most array<array<long>>")
