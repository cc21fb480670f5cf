"""Collocations by mergeable Misra-Gries summaries and a second, exact count (operator 13).

Texts are lower-cased in A-Z, cut at ``. , ; : ! ?`` and line ends into pieces and those at blanks
and tabs into words; phrases are the 1 to 5 words that follow each other within a piece, counted
for each language apart (null: ``und``).

(1) Every phrase has a hash; its high half names one of many hash partitions, its low half is the
key there. A task adds up its own phrases into one summary per partition, which it sends packed
and with its mass. A partition adds up the masses first, which gives its capacity: more than mass
/ threshold counters. Then it merges the summaries one after the other; when they hold more than
the capacity, the largest count beyond it is taken from all. All that is taken is below the
threshold, so every phrase with ``min_count`` occurrences survives, and what has been taken tells
which survivors may have that many. No partition holds more than the counters of two such merges.
(2) The survivors become a bitmap of bounded size. A second pass over the texts sends only phrases
that the bitmap has, now by their words, and Spark adds them up: counts are exact, whatever falls
together in hashes. Scores are exact in decimals.

Edge cases: null and empty texts have no words; texts of separators alone neither; a null language
is ``und``, as are texts that say so; repeated rows count every time; ties in the cuts go to the
smallest ``k``, ties in the order to ``a``, then to the phrase by its bytes; an empty table gives
no rows; other columns, whatever their names, are not read. Long texts are cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value, hold
from clusterloom.llm.words import _POWERS, hash_words, lower_table, mix, split, text_slices, window_hashes

by_value(__name__)

LONGEST = 5
#: Partial counts a task gathers before it sends them.
GATHER = 1 << 21
#: Bits of the bitmap at most: 16 MB. Beyond that it lets more rare phrases through, no fewer.
MAX_BITS = 27
UND = "und"


def _separators() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(b".,;:!?\n\x0b\x0c\r")] = True
    return t


def _parts(first: int, last: int, data: np.ndarray, offsets: np.ndarray, bytes_: int = 1 << 22):
    """Cut a slice of one very long text at separators; other slices stay as they are."""
    if len(data) <= bytes_ or last - first > 1:
        yield first, last, data, offsets
        return
    at = np.flatnonzero(_separators()[data]) + 1
    begin = 0
    while begin < len(data):
        end = len(data)
        if end - begin > bytes_ and len(at):
            k = np.searchsorted(at, begin + bytes_, "right") - 1
            if k < 0 or at[k] <= begin:
                k = np.searchsorted(at, begin, "right")
            end = int(at[k]) if k < len(at) else len(data)
        yield first, last, data[begin:end], np.array([0, end - begin])
        begin = end


def _phrases(batch: pa.RecordBatch, langs: np.ndarray):
    """Of each slice of ``batch`` (text, lang): the lower-cased bytes, words and, for each length,
    the places and hashes of all phrases. ``langs`` are hashes of the rows' languages."""
    lower, separators = lower_table(), _separators()
    gap = separators.copy()
    gap[[9, 32]] = True
    for piece in text_slices(batch.column(0)):
        for first, last, data, offsets in _parts(*piece):
            data = lower[data]
            s = split(first, last, data, offsets, gap)
            if not len(s.start):
                continue
            h = hash_words(s)
            # Words with the same number of separators before them, in one row, share a piece.
            row = s.row_of_word()
            here = np.cumsum(separators[data])[s.start] + row
            lang = langs[first + row]
            found = []
            for n in range(1, LONGEST + 1):
                m = len(h) - n + 1
                if m <= 0:
                    break
                at = np.arange(m) if n == 1 else np.flatnonzero((here[:m] == here[n - 1:]) & (row[:m] == row[n - 1:]))
                found.append((n, at, mix(window_hashes(h, n)[at] ^ lang[at])))
            yield s, data, row, found


def _place(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition of each phrase and its key there."""
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), h.astype(np.uint32)


def _bit(part: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    return (mix((part.astype(np.uint64) << np.uint64(32)) | key) >> np.uint64(64 - bits)).astype(np.int64)


def _lang_hashes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    import xxhash

    names = [UND if x is None else x for x in column.to_pylist()]
    of = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(names)}
    return np.array([of[x] for x in names], np.uint64), names


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


class Summary:
    """Misra-Gries counters of one hash partition, of a fixed capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.taken = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 18):
            self.settle()

    def settle(self) -> None:
        keys, counts = zip((self.keys, self.counts), *self.waiting)
        self.waiting, self.n_waiting = [], 0
        self.keys, self.counts = add_up(np.concatenate(keys), np.concatenate(counts))
        if len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut
            self.taken += cut

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may occur ``least`` times or more."""
        self.settle()
        return self.keys[self.counts + self.taken >= least]


_SENT = "part long, turn int, mass long, ones binary, keys binary, counts binary"


def _summaries(texts: DataFrame, parts: int) -> DataFrame:
    """Packed partial counts of every task, by hash partition; turn 0 holds the mass alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0

        def flush():
            code = np.concatenate(pending)
            pending.clear()
            code.sort()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            counts = np.diff(np.append(first, len(code)))
            code = code[first]
            part, key = (code >> np.uint64(32)).astype(np.int64), code.astype(np.uint32)
            ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
            rows = []
            begin = 0
            for end in ends:
                k, c = key[begin:end], counts[begin:end]
                several = c > 1
                rows.append((int(part[begin]), 0, int(c.sum()), None, None, None))
                rows.append((int(part[begin]), 1, 0, k[~several].tobytes(), k[several].tobytes(), c[several].tobytes()))
                begin = end
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "turn", "mass", "ones", "keys", "counts"])

        for batch in batches:
            langs, _ = _lang_hashes(batch.column(1))
            for _, _, _, found in _phrases(batch, langs):
                for _, _, h in found:
                    part, key = _place(h, parts)
                    pending.append((part.astype(np.uint64) << np.uint64(32)) | key)
                    size += len(h)
                if size > GATHER:
                    yield flush()
                    size = 0
        if pending:
            yield flush()

    return texts.mapInArrow(run, _SENT)


def _survivors(sent: DataFrame, least: int, tasks: int) -> DataFrame:
    """``(part, keys)``: packed keys of each partition that may occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None

        def close():
            keys = summary.survivors(least) if summary else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())], ["part", "n", "keys"])

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != now:
                    if now is not None:
                        yield close()
                    now, mass, summary = part, 0, None
                if batch.column(1)[i].as_py() == 0:
                    mass += batch.column(2)[i].as_py()
                    continue
                if summary is None:  # all masses are in: they sort before the counts
                    summary = Summary(mass // least + 1)
                ones = np.frombuffer(batch.column(3)[i].as_py(), np.uint32)
                keys = np.frombuffer(batch.column(4)[i].as_py(), np.uint32)
                counts = np.frombuffer(batch.column(5)[i].as_py(), np.int64)
                summary.merge(np.concatenate([ones, keys]), np.concatenate([np.ones(len(ones), np.int64), counts]))
        if now is not None:
            yield close()

    return sent.repartition(tasks, "part").sortWithinPartitions("part", "turn").mapInArrow(run, "part long, n long, keys binary")


def _bitmap(found: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of all survivors, gathered by stretches of the bitmap, and their number's logarithm."""
    total = found.agg(F.sum("n")).first()[0] or 0
    bits = min(MAX_BITS, max(20, int(total * 16).bit_length()))
    stretch = 1 << 16

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = np.frombuffer(keys, np.uint32)
                at = np.unique(_bit(np.full(len(k), part), k, bits))
                where, first = np.unique(at // stretch, return_index=True)
                ends = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int64()), pa.array([(at[a:b] % stretch).astype(np.uint16).tobytes() for a, b in zip(first, ends)], pa.binary())],
                    ["stretch", "places"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            for where, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                drawn.setdefault(where, np.zeros(stretch, bool))[np.frombuffer(places, np.uint16)] = True
        if drawn:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(drawn), pa.int64()), pa.array([np.packbits(x).tobytes() for x in drawn.values()], pa.binary())], ["stretch", "drawn"])

    rows = found.select("part", "keys").mapInArrow(spread, "stretch long, places binary").repartition("stretch").mapInArrow(
        draw, "stretch long, drawn binary").collect()  # the bitmap is no larger than 2 ** MAX_BITS bits
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["stretch"] * stretch // 8:(r["stretch"] + 1) * stretch // 8] = np.frombuffer(r["drawn"], np.uint8)
    return out, bits


def _exact(texts: DataFrame, bitmap: np.ndarray, bits: int, parts: int) -> DataFrame:
    """Counts of all phrases that the bitmap has, by words; a null phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bytes | None], int] = {}

        def flush():
            langs, names = zip(*counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "phrase", "n"])
            counts.clear()
            return out

        for batch in batches:
            hashes, langs = _lang_hashes(batch.column(1))
            for s, data, row, found in _phrases(batch, hashes):
                raw = data.tobytes()
                words = np.bincount(row, minlength=s.last - s.first)
                for r in np.flatnonzero(words):
                    who = (langs[s.first + r], None)
                    counts[who] = counts.get(who, 0) + int(words[r])
                for n, at, h in found:
                    part, key = _place(h, parts)
                    b = _bit(part, key, bits)
                    hit = np.flatnonzero((bitmap[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1)
                    if not len(hit):
                        continue
                    at, h = at[hit], h[hit]
                    order = np.argsort(h, kind="stable")
                    at, h = at[order], h[order]
                    # Equal hashes count as one phrase if their bytes agree by another hash.
                    other = _spans_hash(data, s.start[at], s.end[at + n - 1])
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])))
                    many = np.diff(np.append(first, len(h)))
                    for i, m in zip(at[first].tolist(), many.tolist()):
                        if n == 1:
                            phrase = raw[s.start[i]:s.end[i]]
                        else:
                            phrase = b" ".join(raw[s.start[j]:s.end[j]] for j in range(i, i + n))
                        who = (langs[s.first + int(row[i])], phrase)
                        counts[who] = counts.get(who, 0) + m
                if len(counts) > GATHER // 16:
                    yield flush()
        if counts:
            yield flush()

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) * np.uint64(2) + np.uint64(3)) * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def frequent(docs: DataFrame, *, min_count: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Exact counts ``(lang, phrase, n)`` of all phrases of 1 to 5 words with ``min_count`` or more
    occurrences, and one row per language with a null phrase that counts all words."""
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    splits = max(1, texts.rdd.getNumPartitions())
    parts = 8 * splits
    found = hold(_survivors(_summaries(texts, parts), min_count, 2 * splits))
    bitmap, bits = _bitmap(found)
    counted = _exact(texts, bitmap, bits, parts)
    return counted.filter((F.col("n") >= min_count) | F.col("phrase").isNull())


def mine(docs: DataFrame, *, min_count: int = 100, keep: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``keep`` collocations: ``lang, rank, phrase, a, l, r, n, score``."""
    counts = hold(frequent(docs, min_count=min_count, text=text, lang=lang))
    words = counts.filter("phrase IS NULL").select("lang", F.col("n").alias("all"))
    known = counts.filter("phrase IS NOT NULL").select("lang", "phrase", F.col("n").alias("f"))
    several = known.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    cuts = several.select(
        "lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("_right"))
    part = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"]).join(words, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("_top", (big("a") * F.lit(1000).cast("decimal(5,0)")).cast("decimal(19,0)") * big("all")).withColumn(
        "score", F.expr("_top div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("all").alias("n"))).alias("b")).select(
        "lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    # A phrase is never rarer than a longer one around it; so the next longer ones decide.
    inner = several.filter(F.size("w") > 2).select(
        "lang", F.col("f").alias("a"), F.explode(F.array(
            F.array_join(F.slice("w", 1, F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase")).distinct()
    left = best.join(inner, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of many shares of a language are ranked before the language is.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = left.withColumn("_s", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= keep)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
