"""Benchmark decontamination by templates (operator 10).

Words become a template: numbers, units after a number, and names turn into typed placeholders,
everything else is lower-cased. Names are read in two ways, each matched by itself: as capitalised
words inside a sentence, and, wherever they stand, as runs of capitalised words that are not in a
list of common ones (a run is one slot). A third reading keeps all words as they are, so that
verbatim copies match whatever their share of placeholders is. Windows of template words
of the benchmark are hash-joined with those of the documents. The windows of one item that lie in
one document at one offset form an alignment. It counts once it covers ``min_cover`` words (or
the whole item, if shorter) and either its slots map one-to-one between item and document, which
catches re-parameterised questions, or that many of its words are no placeholders.

Documents are filtered by a bitmap of the benchmark's window hashes before anything is shuffled;
its size is a parameter, so a larger benchmark lets more windows through but loses none.

Edge cases: null and empty texts match nothing; windows with fewer than ``min_literal`` words that
are no placeholders are evidence of verbatim copies only; items of fewer than ``min_literal`` words
of any kind are no evidence and are not searched; an item shorter than a window is one
window; repeated items count once; repeated rows get the same result; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.llm.common import by_value, fenced, hold, released
from clusterloom.llm.words import (
    Slice, hash_words, lower_table, mix, space_table, split, text_slices, window_hashes, windows_inside,
)

by_value(__name__)

WIDTH, MIN_COVER, MIN_LITERAL = 8, 13, 4
BITMAP_BITS = 24
UNITS = (
    "km m cm mm mi ft in kg g mg lb lbs oz l ml s h min kmh mph usd eur percent "
    "kilometer kilometers kilometre kilometres meter meters metre metres mile miles foot feet inch inches yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents degree degrees"
).split()
#: Capitalised forms of these are no names, wherever they stand.
COMMON = (
    "a an the this that these those i you he she it we they my your his her its our their me him us them who whom whose which what when "
    "where why how if then else and or but nor so yet for of in on at by to from with without within about after before during until "
    "since while because although though as than is are was were be been being am do does did have has had can could shall should "
    "would must not no yes there here each every all both some any many much more most other another such only also one two three "
    "four five six seven eight nine ten let find calculate compute determine suppose given consider assume show prove solve write "
    "choose select explain describe read answer question however therefore thus hence now today later first second third finally "
    "der die das den dem des ein eine einen einem einer ich er sie es wir ihr und oder aber wenn dann wie was wer wo warum welche "
    "welcher welches wann im am zum zur von mit bei nach aus auf für ist sind war hat haben kann nicht "
    "le la les un une des du de et ou mais si je il elle nous vous ils elles qui que quoi quand où comment combien quel quelle dans "
    "sur avec pour par est sont ce cette ces el los las una unos unas y o pero cuando cómo cuántos cuántas qué quién dónde en con por "
    "para es son se su"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (3, 5, 7))
#: Readings: names inside sentences, word by word; capitalised words anywhere, runs merged; no slots.
SENTENCE, FORM, EXACT = 0, 1, 2
_SLOT = {1: "number", 2: "name", 3: "unit"}


@dataclass
class Tokens:
    """Tokens of a slice by one reading; a run of names is one token where names are merged."""

    s: Slice
    reading: int
    hash: np.ndarray
    kind: np.ndarray  # 0 literal, 1 number, 2 name, 3 unit
    first: np.ndarray  # the first word of each token, and the number of words
    offsets: np.ndarray  # of each row's tokens


def _list_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(hash_words(split(0, 1, data, np.array([0, len(data)]), space_table())))


def template_slices(column: pa.Array) -> Iterator[Tokens]:
    """Words of letters and digits (digits may hold points and commas) with their kinds, by every reading."""
    lower = lower_table()
    gap = np.ones(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        gap[a:b] = False
    digit = np.zeros(256, bool)
    digit[48:58] = True
    stop = np.zeros(256, np.int32)
    stop[[10, 13, 33, 46, 58, 63]] = 1
    apart = (gap & ~space_table()).astype(np.int32)  # between two words these end a run of names
    apart[[39, 45]] = 0
    units, common = _list_hashes(UNITS), _list_hashes(COMMON)
    for first, last, data, offsets in text_slices(column):
        data = data.copy()
        d = digit[data]
        inner = np.flatnonzero(((data[1:-1] == 44) | (data[1:-1] == 46)) & d[:-2] & d[2:]) + 1 if len(data) > 2 else np.zeros(0, int)
        shown = data.copy()
        data[inner] = 48  # keeps a number in one word
        s = split(first, last, data, offsets, gap)
        s.data = shown
        raw = hash_words(s, lower[shown])
        n = len(raw)
        if not n:
            continue
        head = shown[s.start]
        second = shown[np.minimum(s.start + 1, len(shown) - 1)]
        upper = ((head >= 65) & (head < 91)) | ((head == 0xC3) & (second >= 0x80) & (second < 0x9F))
        opens_row = np.zeros(n, bool)
        opens_row[s.word_offsets[:-1][np.diff(s.word_offsets) > 0]] = True

        def between(count: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(count[shown])])
            return np.concatenate([[True], sums[s.start[1:]] > sums[s.end[:-1]]]) | opens_row

        def typed(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h, kind = raw.copy(), np.zeros(n, np.int8)
            kind[name] = 2
            kind[digit[head]] = 1
            after = np.flatnonzero(kind[:-1] == 1) + 1
            after = after[~opens_row[after]]
            kind[after[np.isin(raw[after], units) & (kind[after] != 1)]] = 3
            for k, value in ((1, NUMBER), (2, NAME), (3, UNIT)):
                h[kind == k] = mix(np.array([value], np.uint64))[0]
            return h, kind

        h, kind = typed(upper & ~between(stop))
        yield Tokens(s, SENTENCE, h, kind, np.arange(n + 1), s.word_offsets)
        h, kind = typed(upper & ~np.isin(raw, common))
        begins = between(apart) | (kind != 2)
        begins[1:] |= kind[:-1] != 2
        before = np.concatenate([[0], np.cumsum(begins)])
        yield Tokens(s, FORM, h[begins], kind[begins], np.append(np.flatnonzero(begins), n), before[s.word_offsets])
        yield Tokens(s, EXACT, raw, np.zeros(n, np.int8), np.arange(n + 1), s.word_offsets)


def _slots(t: Tokens, at: int, width: int, a: int, b: int) -> list[str]:
    """Slots of a window: kind and lower-cased value, after ``e:`` for a name at the end of the row
    ``a`` to ``b`` that is merged, so that it may take in a neighbour's name elsewhere, else ``-:``."""
    out = []
    for i in range(at, at + width):
        if t.kind[i]:
            words = range(t.first[i], t.first[i + 1])
            value = " ".join(bytes(t.s.data[t.s.start[j]:t.s.end[j]]).decode("utf-8", "replace").lower() for j in words)
            edge = t.reading == FORM and t.kind[i] == 2 and i in (a, b - 1)
            out.append(f"{'e' if edge else '-'}:{_SLOT[int(t.kind[i])]}:{value}")
    return out


def _windows(frame_id: str, id_type: str, df: DataFrame, widths: dict[int, list[int]], bitmap: np.ndarray | None,
             bits: int, width: int, min_literal: int) -> DataFrame:
    """Windows with enough literals; of items (no ``bitmap``) with the places of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in template_slices(batch.column(2)):
                sizes, words = np.diff(t.offsets), np.diff(t.s.word_offsets)
                row_of = np.repeat(np.arange(len(sizes)), sizes)
                literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
                for w in widths.get(t.reading, []) if bitmap is not None else sorted({width, *(int(x) for x in sizes if 0 < x < width)}):
                    if len(t.hash) < w:
                        continue
                    at = windows_inside(t.offsets, w)
                    h = window_hashes(t.hash, w)[at]
                    if bitmap is not None:
                        place = (h >> np.uint64(64 - bits)).astype(np.int64)
                        hit = (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                        at, h = at[hit], h[hit]
                    elif w < width:  # a short item is one window
                        only = sizes[row_of[at]] == w
                        at, h = at[only], h[only]
                    ok = literal[at + w] - literal[at] >= min_literal
                    at, h = at[ok], h[ok]
                    rows = row_of[at]
                    for a in range(0, len(at), 20000):
                        part = slice(a, a + 20000)
                        take = pa.array(rows[part] + t.s.first)
                        where = zip(at[part], rows[part])
                        spots = [(i, np.arange(t.first[i], t.first[i + w]), t.s.word_offsets[r]) for i, r in where] if bitmap is None else None
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(take), batch.column(1).take(take),
                            pa.array(at[part] - t.offsets[rows[part]], pa.int64()),
                            pa.array(h[part].view(np.int64)), pa.array(np.full(len(take), w), pa.int32()),
                            pa.array(np.full(len(take), t.reading), pa.int32()),
                            pa.array([_slots(t, i, w, t.offsets[r], t.offsets[r + 1]) for i, r in zip(at[part], rows[part])], pa.list_(pa.string())),
                            pa.array(words[rows[part]], pa.int64()),
                            pa.array([x - o for _, x, o in spots] if spots is not None else [None] * len(take), pa.list_(pa.int64())),
                            pa.array([t.first[i:i + w][t.kind[i:i + w] == 0] - o for i, _, o in spots] if spots is not None else [None] * len(take),
                                     pa.list_(pa.int64())),
                        ], [frame_id, "_t", "_pos", "_hash", "_width", "_reading", "_slots", "_words", "_at", "_literal"])

    return df.mapInArrow(released(run), f"{frame_id} {id_type}, _t long, _pos long, _hash long, _width int, _reading int, "
                              "_slots array<string>, _words long, _at array<long>, _literal array<long>")


def matches(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, min_cover: int = MIN_COVER,
    min_literal: int = MIN_LITERAL, bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """``(doc_id, _t, item_id, kind, covered, n_words)``; ``_t`` is the hash of the text.

    ``kind`` is ``exact`` where all slots agree, else ``reparameterised``; ``covered`` counts the
    item's words in the best alignment.
    """
    items = benchmark.select("item_id", F.xxhash64("text").alias("_t"), "text").filter("text is not null").distinct()
    item_windows = hold(_windows(
        "item_id", items.schema["item_id"].dataType.simpleString(), items, {}, None, 0, width, min_literal
    ).drop("_t"))
    # At most 2^bitmap_bits / 64 words reach the driver, and at most ``width`` widths.
    place = F.shiftrightunsigned("_hash", 64 - bitmap_bits)
    bitmap = np.zeros(max(1, 1 << bitmap_bits >> 6), np.uint64)
    for r in item_windows.groupBy(F.shiftright(place, 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(_hash, %d), 64) as int))" % (64 - bitmap_bits))).alias("b")).collect():
        bitmap[r.w] = np.uint64(r.b & 0xFFFFFFFFFFFFFFFF)
    widths: dict[int, list[int]] = {}
    for r in item_windows.select("_reading", "_width").distinct().collect():
        widths.setdefault(r[0], []).append(r[1])
    narrow = docs.select("doc_id", F.xxhash64("text").alias("_t"), "text")
    found = _windows("doc_id", docs.schema["doc_id"].dataType.simpleString(), narrow, widths, bitmap, bitmap_bits, width, min_literal)
    item_windows = item_windows.select(
        "item_id", "_hash", "_width", "_reading", F.col("_pos").alias("_ipos"), F.col("_slots").alias("_islots"),
        F.col("_words").alias("_iwords"), "_at", "_literal")
    aligned = (
        found.drop("_words", "_at", "_literal").join(item_windows, ["_hash", "_width", "_reading"])
        .withColumn("_diag", F.col("_pos") - F.col("_ipos"))
    )
    key = ["doc_id", "_t", "item_id", "_reading", "_diag"]
    # An item's length bounds the sets of one alignment.
    cover = aligned.groupBy(*key).agg(
        F.first("_iwords").alias("_iwords"),
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("_at", "_literal")],
        F.array_distinct(F.flatten(F.collect_set(F.transform(F.arrays_zip(F.col("_islots"), F.col("_slots")), lambda z: F.struct(
            F.substring(z["_islots"], 3, 1 << 20).alias("a"), F.substring(z["_slots"], 3, 1 << 20).alias("b"),
            z["_islots"].startswith("e:").alias("e")))))).alias("_pairs"),
    ).withColumns({"_inner": F.filter("_pairs", lambda p: ~p["e"]), "_edges": F.filter("_pairs", lambda p: p["e"])})
    # A name at an item's end may have run into the document's next name.
    edge_agrees = F.forall("_edges", lambda e: F.forall("_inner", lambda p: F.when(
        e["a"] == p["a"], (e["b"] == p["b"]) | e["b"].endswith(F.concat(F.lit(" "), F.substring(p["b"], len("name:") + 1, 1 << 20)))
        | e["b"].startswith(F.concat(p["b"], F.lit(" ")))).otherwise(e["b"] != p["b"])))
    one_to_one = edge_agrees & (
        (F.size(F.array_distinct(F.transform("_inner", lambda p: p["a"]))) == F.size("_inner"))
        & (F.size(F.array_distinct(F.transform("_inner", lambda p: p["b"]))) == F.size("_inner"))
    )
    needed = F.least(F.lit(min_cover), F.col("_iwords"))
    covered = F.size("_at")
    good = cover.select(
        *key, "_iwords", covered.cast("long").alias("covered"),
        F.when((F.col("_reading") == EXACT) | F.forall("_pairs", lambda p: p["a"] == p["b"]), "exact").otherwise("reparameterised").alias("kind"),
        ((covered >= needed) & (one_to_one | (F.size("_literal") >= needed))).alias("_ok"),
    ).filter("_ok")
    best = good.groupBy("doc_id", "_t", "item_id").agg(
        F.max(F.struct("covered", F.when(F.col("kind") == "exact", 1).otherwise(0).alias("e"), "kind", "_iwords")).alias("_b"))
    return best.select("doc_id", "_t", "item_id", "_b.kind", "_b.covered", F.col("_b._iwords").alias("n_words"))


def _joined(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    hits = hits.withColumnsRenamed({"doc_id": "_d", "_t": "_h"})
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), how)


def flag(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, contaminated, n_items, item_id, kind, covered`` (of its best item)."""
    hits = matches(docs, benchmark, **options).groupBy("doc_id", "_t").agg(
        F.count("*").alias("n_items"), F.max(F.struct("covered", F.col("item_id").alias("item_id"), "kind")).alias("_b"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"))
    return _joined(rows, hits, "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "_b.item_id", "_b.kind", "_b.covered")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a match, all columns as they were, whatever their names."""
    docs, back = fenced(docs, "doc_id", "text")
    hits = hold(matches(docs, benchmark, **options).select("doc_id", "_t").distinct())
    return back(_joined(docs.withColumn("_t", F.xxhash64("text")), hits, "left_anti"))
