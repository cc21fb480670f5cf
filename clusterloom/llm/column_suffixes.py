"""Removal of long repeated byte strings by column-wise suffix sorting (operator 7).

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in the same
text or another one. The method:

(1) Every window of ``length`` bytes has an anchor, its ``GRAM`` bytes with the least hash (the
leftmost of equals), so equal windows have equal anchors at equal offsets. Windows of one text
with one anchor and offsets of one block of ``BLOCKS[0]`` form a segment; all windows of a block
share its core around the anchor, and the core's hash is the segment's key. Keys of one segment
cannot repeat and go no further; only hashes have been shuffled so far.
(2) Where all segments of a key are equal they all repeat. Else the key's distinct segments are
sorted column by column: suffixes that could match start in the same column of the alignment, so
each round puts one symbol of every segment before its suffix, moves the order by that column of
the collection's Burrows-Wheeler transform, and updates the common prefixes of neighbours. Rounds
append the starts whose common prefix reaches ``length`` to a sequential spool file, which leaves
memory when it grows and is read once at the end. Many keys share one sort.
(3) A key with more than ``limit`` distinct segments is not sorted in one task: its segments are
cut into smaller blocks of offsets with longer cores and treated again, down to single windows,
which are equal or have different keys. So no group grows with the data.

The full transform of whole documents would take as many passes over all text as the longest text
has bytes; anchoring keeps rounds at twice ``length``.

Edge cases: null and empty texts and texts shorter than ``length`` lose nothing; of copies of a
text that is long enough every byte goes; repeated rows count as copies; null ids are kept.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value, fenced, hold, released, small_batches
from clusterloom.llm.words import _POWERS, mix, text_slices

by_value(__name__)

LENGTH, GRAM, LIMIT = 400, 32, 20000
#: Offsets of a block at each level; the last one must be 1.
BLOCKS = (185, 16, 1)
PIECE = 1 << 20
SORT_SEGMENTS = 8192
SPOOL_BYTES = 1 << 24


class _Hashes:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _POWERS.get(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=self.total[1:])

    def of(self, start, end) -> np.ndarray:
        size = (np.asarray(end) - np.asarray(start)).astype(np.uint64)
        return mix((self.total[end] - self.total[start]) * self.down[start] + size * np.uint64(0x9E3779B1))


def anchors(h: _Hashes, n: int, length: int) -> np.ndarray:
    """Anchor of the window at each start ``0 .. n - length``, by minima of blocks."""
    width = length - GRAM + 1
    grams = n - GRAM + 1
    at = np.arange(grams)
    # Half of the bits order by hash, the others by place; never more or less, so all texts agree.
    value = (h.of(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = -grams % width
    rows = np.concatenate([value, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    starts = n - length + 1
    least = np.minimum(ahead[:starts], behind[width - 1:width - 1 + starts])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(h: _Hashes, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, block: int, length: int):
    """Cut runs of starts ``first .. last`` with one anchor into blocks of offsets.

    Returns ``(key, hash, lo, hi, anchor, run)`` arrays, one entry per segment.
    """
    low, high = (anchor - last) // block, (anchor - first) // block
    count = high - low + 1
    run = np.repeat(np.arange(len(first)), count)
    index = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    p = anchor[run]
    lo = np.maximum(first[run], p - (index + 1) * block + 1)
    hi = np.minimum(last[run], p - index * block)
    core_from, core_to = p - index * block, p - (index + 1) * block + 1 + length
    key = mix(h.of(core_from, core_to) + index.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(block))
    # The place of the anchor is part of a segment's identity.
    whole = mix(h.of(lo, hi + length) ^ mix((p - lo).astype(np.uint64) + np.uint64(17)))
    return key, whole, lo, hi, p, run


def _runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return first, np.append(first[1:], len(anchor)) - 1


_ROW = "_t long, _row long, key long, seg long, lo long, hi long, shift int"


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts, places counted in the text; ``shift`` is anchor minus ``lo``."""

    return docs.select("_t", "_row", "text").mapInArrow(released(lambda batches: _segment_batches(batches, length)), _ROW)


def _segment_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0

    def flush(batch):
        row, key, whole, lo, hi, shift = (np.concatenate(x) for x in zip(*out))
        out.clear()
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)),
             pa.array(lo), pa.array(hi), pa.array(shift)], ["_t", "_row", "key", "seg", "lo", "hi", "shift"])

    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column(2)):
            for r in range(last - first):
                text = data[offsets[r]:offsets[r + 1]]
                for begin in range(0, max(0, len(text) - length + 1), PIECE):
                    piece = text[begin:begin + PIECE + length - 1]
                    h = _Hashes(piece)
                    at = anchors(h, len(piece), length)
                    a, b = _runs(at)
                    key, whole, lo, hi, p, _ = segments(h, a, b, at[a], BLOCKS[0], length)
                    out.append((np.full(len(key), first + r), key, whole, lo + begin, hi + begin, (p - lo).astype(np.int32)))
                    size += len(key)
                    if size > 100000:
                        yield flush(batch)
                        size = 0
        if out:
            yield flush(batch)
            size = 0


def sort_columns(group: np.ndarray, texts: list[bytes], shift: np.ndarray, length: int) -> list[np.ndarray]:
    """Starts (from each segment's begin) whose ``length`` bytes another segment of its group has.

    ``group`` is ascending; ``shift`` is where a segment has its anchor. Suffixes are compared
    within a column of the alignment on the anchors, from the last column to the first.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts])
    left, right = int(shift.max()), int((size - shift).max())
    cells = np.zeros((left + right, m), np.uint8)
    for i, t in enumerate(texts):
        a = left - shift[i]
        cells[a:a + size[i], i] = np.frombuffer(t, np.uint8)
    begin, end = left - shift, left - shift + size
    lively = np.bincount(end, minlength=left + right + 1)
    ends = np.argsort(end, kind="stable")[::-1]
    leaves = np.bincount(begin, minlength=left + right + 1)
    order = np.zeros(0, np.int64)  # segments by group and by their suffix from this column on
    common = np.zeros(0, np.int64)  # common prefix with the one before; 0 across groups
    entered = 0
    with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as spool:
        for column in range(left + right - 1, -1, -1):
            if leaves[column + 1] and len(order):
                keep = np.flatnonzero(begin[order] <= column)
                common = _least(common, keep)
                order = order[keep]
            new = lively[column + 1]
            if new:  # the empty suffix comes before all others of its group
                fresh = np.sort(ends[entered:entered + new])
                entered += new
                order = np.concatenate([fresh, order])
                common = np.concatenate([np.zeros(new, np.int64), common])
                by_group = np.argsort(group[order], kind="stable")
                common = _least(common, by_group)
                order = order[by_group]
            if not len(order):
                continue
            symbol = cells[column, order].astype(np.int64) + (group[order] << 8)
            rank = np.argsort(symbol, kind="stable")
            symbol = symbol[rank]
            common = _least(common, rank)
            common[0] = 0
            common[1:] = np.where(symbol[1:] == symbol[:-1], np.minimum(common[1:] + 1, length), 0)
            order = order[rank]
            full = common >= length
            full[:-1] |= full[1:]
            hit = order[full]
            if len(hit):
                spool.write(np.array([column, len(hit)], np.int64).tobytes() + hit.tobytes())
        spool.seek(0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while head := spool.read(16):
            column, n = np.frombuffer(head, np.int64)
            who = np.frombuffer(spool.read(8 * int(n)), np.int64)
            found.append((who, column - begin[who]))
    if not found:
        return [np.zeros(0, np.int64)] * m
    who, at = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((at, who))
    return np.split(at[by], np.cumsum(np.bincount(who, minlength=m))[:-1])


def _least(common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefixes after a reordering: the least value between two old places."""
    out = np.zeros(len(rank), np.int64)
    if len(rank) < 2:
        return out
    low, high = np.minimum(rank[:-1], rank[1:]) + 1, np.maximum(rank[:-1], rank[1:]) + 1
    ends = np.append(common, 0)
    out[1:] = np.minimum.reduceat(ends, np.stack([low, high], 1).ravel())[::2]
    return out


def _spans(starts: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()


_FOUND = "key long, seg long, froms array<long>, tos array<long>"


def _sort_groups(rows: DataFrame, length: int) -> DataFrame:
    """``(key, seg, shift, body)`` to the repeated starts of every segment, by keys."""

    def work(batch: list[dict]) -> pa.RecordBatch:
        keys = np.array([r["key"] for r in batch])
        group = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
        hits = sort_columns(group, [r["body"] for r in batch], np.array([r["shift"] for r in batch]), length)
        spans = [_spans(x) for x in hits]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array([r["seg"] for r in batch], pa.int64()), pa.array([a for a, _ in spans], pa.list_(pa.int64())),
             pa.array([b for _, b in spans], pa.list_(pa.int64()))], ["key", "seg", "froms", "tos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(pending) >= SORT_SEGMENTS and r["key"] != pending[-1]["key"]:
                    yield work(pending)
                    pending = []
                pending.append(r)
        if pending:
            yield work(pending)

    return rows.select("key", "seg", "shift", "body").repartition("key").sortWithinPartitions("key").mapInArrow(released(run), _FOUND)


def _cut_smaller(rows: DataFrame, block: int, length: int) -> DataFrame:
    """Segments of smaller blocks: ``(key, seg, sub, part, lo, hi, shift, body, twice)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body = np.frombuffer(r["body"], np.uint8)
                h = _Hashes(body)
                last = len(body) - length
                sub, part, lo, hi, p, _ = segments(h, np.array([0]), np.array([last]), np.array([r["shift"]]), block, length)
                for i in range(len(sub)):
                    out.append((r["key"], r["seg"], int(sub[i:i + 1].view(np.int64)[0]), int(part[i:i + 1].view(np.int64)[0]), int(lo[i]),
                                int(hi[i]), int(p[i] - lo[i]), bytes(r["body"][lo[i]:hi[i] + length]), r["twice"]))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["key", "seg", "sub", "part", "lo", "hi", "shift", "body", "twice"])

    return rows.select("key", "seg", "shift", "body", "twice").mapInArrow(
        released(run), "key long, seg long, sub long, part long, lo long, hi long, shift int, body binary, twice boolean")


def _resolve(rows: DataFrame, level: int, length: int, limit: int) -> DataFrame:
    """Repeated starts of distinct segments ``(key, seg, shift, body, twice)`` that share a key
    with another one; ``twice`` says that a segment itself occurs more than once."""
    counts = rows.groupBy("key").agg(F.count("*").alias("m"))
    large = hold(counts.filter(F.col("m") > limit).select("key"))
    if level + 1 >= len(BLOCKS) or large.isEmpty():
        return _sort_groups(rows, length)
    small = _sort_groups(rows.join(large, "key", "left_anti"), length)
    parts = hold(_cut_smaller(rows.join(large, "key", "left_semi"), BLOCKS[level + 1], length))
    each = parts.groupBy("sub", "part").agg(
        F.first("shift").alias("shift"), F.first("body").alias("body"), (F.max("twice") | (F.count("*") > 1)).alias("twice"))
    several = each.groupBy("sub").agg(F.count("*").alias("m")).filter("m > 1").select("sub")
    again = each.join(several, "sub", "left_semi").select(F.col("sub").alias("key"), F.col("part").alias("seg"), "shift", "body", "twice")
    found = _resolve(hold(again), level + 1, length, limit).select(
        F.col("key").alias("sub"), F.col("seg").alias("part"), F.explode(F.arrays_zip("froms", "tos")).alias("z"))
    by_sort = parts.join(found, ["sub", "part"]).select("key", "seg", (F.col("lo") + F.col("z.froms")).alias("a"), (F.col("lo") + F.col("z.tos")).alias("b"))
    whole = parts.join(each.filter("twice").select("sub", "part"), ["sub", "part"]).select("key", "seg", F.col("lo").alias("a"), F.col("hi").alias("b"))
    deeper = by_sort.unionByName(whole).groupBy("key", "seg").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("z"))
    return small.unionByName(deeper.select("key", "seg", F.col("z.a").alias("froms"), F.col("z.b").alias("tos")))


def repeated(docs: DataFrame, *, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """``(_t, starts)``: for each text hash the ranges ``(a, b)`` of starts of repeated strings."""
    text = docs.select(F.xxhash64("text").alias("_t"), "doc_id", "text").filter(F.octet_length("text") >= length)
    text = text.withColumn("_row", F.xxhash64("doc_id", "_t"))
    rows = hold(_segment_rows(text, length))
    place = F.struct("_t", "lo")
    # Held apart from the join, so that rows of one frequent key can be dealt to several tasks.
    keys = hold(rows.groupBy("key").agg(
        F.min(place).alias("a"), F.max(place).alias("b"), F.min("seg").alias("s"), F.max("seg").alias("u")
    ).filter("a <> b").select("key", (F.col("s") != F.col("u")).alias("several")))
    alive = hold(rows.join(keys, "key"))
    mixed = alive.filter("several").groupBy("key", "seg").agg(
        F.min(F.struct("_t", "lo", "_row")).alias("a"), F.max(place).alias("b"), F.first("hi").alias("_hi"), F.first("lo").alias("_lo"), F.first("shift").alias("shift"))
    mixed = hold(mixed.select(
        "key", "seg", F.col("a._row").alias("_row"), F.col("a.lo").alias("lo"), (F.col("_hi") - F.col("_lo")).alias("n"), "shift",
        ((F.col("a._t") != F.col("b._t")) | (F.col("a.lo") != F.col("b.lo"))).alias("twice")))
    wanted = mixed.groupBy("_row").agg(F.collect_list(F.struct("key", "seg", "lo", "n", "shift", "twice")).alias("w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "seg", "shift", "body", "twice"]
        for batch in small_batches(batches):
            out = []
            for text, want in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for w in want:
                    out.append((w["key"], w["seg"], w["shift"], text[w["lo"]:w["lo"] + w["n"] + length], w["twice"]))
                    if len(out) == 20000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    # A row that is there twice sends its segments twice; each key takes a segment once.
    bodies = text.join(wanted, "_row").select("text", "w").mapInArrow(
        released(cut), "key long, seg long, shift int, body binary, twice boolean").dropDuplicates(["key", "seg"])
    found = _resolve(hold(bodies), 0, length, limit).filter(F.size("froms") > 0)
    sorted_hits = alive.filter("several").join(found, ["key", "seg"]).select(
        "_t", F.explode(F.arrays_zip("froms", "tos")).alias("z"), "lo").select(
        "_t", (F.col("lo") + F.col("z.froms")).alias("a"), (F.col("lo") + F.col("z.tos")).alias("b"))
    equal = alive.filter("several").join(mixed.filter("twice").select("key", "seg"), ["key", "seg"]).unionByName(alive.filter("not several"))
    copies = text.groupBy("_t").agg(F.count("*").alias("m"), F.max(F.octet_length("text")).alias("n")).filter("m > 1").select(
        "_t", F.lit(0).cast("long").alias("a"), (F.col("n") - length).cast("long").alias("b"))
    ranges = sorted_hits.unionByName(equal.select("_t", F.col("lo").alias("a"), F.col("hi").alias("b"))).unionByName(copies)
    # One text's ranges are no more than its windows.
    return ranges.groupBy("_t").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("starts"))


def remove(docs: DataFrame, *, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """All rows of ``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``, which
    replace columns of these names; all other columns stay, whatever their names."""
    apart, _ = fenced(docs, "doc_id", "text")
    out = _remove(apart, length, limit)
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    return out.select(*[F.col(n).alias(o) for n, o in zip(apart.columns, docs.columns) if o not in added], *added)


def _remove(docs: DataFrame, length: int, limit: int, decode: bool = False) -> DataFrame:
    """``docs`` with ``kept`` and the counts; with ``decode`` the text itself is cut, and
    ``n_removed`` is all that is added."""
    found = hold(repeated(docs, length=length, limit=limit)).select("_t", F.col("starts.a").alias("_a"), F.col("starts.b").alias("_b"))
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    rows = docs.select(*names, F.xxhash64("text").alias("_t")).join(found, "_t", "left").select(*names, "_a", "_b")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            froms, tos = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            marked = np.flatnonzero(froms.is_valid().to_numpy(zero_copy_only=False))
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            kept = [t or b"" for t in texts]
            size = [len(t) for t in kept]
            gone, spans = [0] * len(kept), [0] * len(kept)
            for i in marked:
                out, at = [], 0
                for a, b in zip(froms[i].as_py(), tos[i].as_py()):
                    if a > at or not spans[i]:
                        out.append(kept[i][at:a])
                        spans[i] += 1
                        at = a
                    at = max(at, b + length)
                out.append(kept[i][at:])
                kept[i] = b"".join(out)
                gone[i] = size[i] - len(kept[i])
            if decode:
                shown = list(batch.columns[:-2])
                if any(gone):  # only texts that were cut are decoded
                    old = batch.column(text_at).to_pylist()
                    shown[text_at] = pa.array([k.decode("utf-8", "ignore") if g else t for k, g, t in zip(kept, gone, old)], pa.string())
                yield pa.RecordBatch.from_arrays([*shown, pa.array(gone, pa.int64())], [*names, "n_removed"])
                continue
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())],
                [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(released(run), schema + (", n_removed long" if decode else ", kept binary, n_bytes long, n_removed long, n_spans long"))


def remove_text(docs: DataFrame, *, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``text`` cut and all other columns as they were: a null text stays null, and
    what is left of a character whose other bytes went is dropped too. ``n_chars``, if there, is
    counted anew for texts that were cut."""
    apart, back = fenced(docs, "doc_id", "text", "n_chars")
    out = _remove(apart, length, limit, decode=True)
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, counted).otherwise(F.col("n_chars")))
    return back(out)
