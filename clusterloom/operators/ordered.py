"""Ordered-sequence building blocks that never put one sequence in one task.

A plain ``Window.partitionBy(contig)`` sends a whole contig to one task. Here an ordered
sequence is split into chunks of consecutive rows; every chunk is scanned on its own, one
summary row per chunk is combined along the sequence, and the carried value is joined back on
``(contig, chunk)``. A sequence of 10**11 rows leaves about 1.5 million summary rows.

``parts`` are the (non-null) columns naming the sequence, ``pos`` its LONG position.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from clusterloom.session import cut_lineage, hold

# Workers need not have this package installed: its task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16
_SPLIT_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def index_rows(
    df: DataFrame, parts: Sequence[str], order: Sequence[str | Column], name: str = "pos"
) -> DataFrame:
    """Dense 0-based position of every row within ``parts``, ordered by ``order``.

    Rows are range-partitioned on (parts, order), so a dominant sequence spreads over many
    tasks. The sorted rows are checkpointed: the partition ids must not change between the
    counting pass and the numbering pass. ``order`` must be total within ``parts``.
    """
    keys = [F.col(p) for p in parts] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rowid", F.monotonically_increasing_id())
    ).withColumn("_split", F.shiftright("_rowid", _SPLIT_BITS))
    before = (
        W.partitionBy(*(parts or [F.lit(0)]))
        .orderBy("_split")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    segments = (
        placed.groupBy(*parts, "_split")
        .agg(F.min("_rowid").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    # Their size must be known, so that the sorted rows are not shuffled to join them: of one sequence there is a
    # row for each partition, of several they are held.
    segments = hold(segments) if parts else df.sparkSession.createDataFrame(segments.toArrow())
    return (
        placed.join(segments, [*parts, "_split"])
        .withColumn(name, F.col("_rowid") - F.col("_first") + F.col("_before"))
        .drop("_rowid", "_split", "_first", "_before")
    )


def chunk_of(pos: str, chunk_rows: int | None = None) -> Column:
    return F.floor(F.col(pos) / F.lit(chunk_rows or CHUNK)).cast("long")


def scan(
    df: DataFrame,
    parts: Sequence[str],
    pos: str,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    upcoming: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add running values along each sequence.

    ``sums``: inclusive running sum. ``lasts``: last non-null value at or before the row.
    ``upcoming``: first non-null value at or after it. ``prevs``/``nexts``: the value on the
    adjacent row (null at the ends). ``totals``: an aggregate over the whole sequence, given as
    a sum-able per-row value.
    """
    sums, lasts, upcoming = sums or {}, lasts or {}, upcoming or {}
    prevs, nexts, totals = prevs or {}, nexts or {}, totals or {}
    base = df.withColumn("_chunk", chunk_of(pos, chunk_rows))
    value = {}
    for group, items in (
        ("s", sums), ("l", lasts), ("u", upcoming), ("p", prevs), ("n", nexts), ("t", totals)
    ):
        for i, (_name, expr) in enumerate(items.items()):
            value[f"_{group}{i}"] = expr
    base = base.withColumns(value) if value else base

    where = F.col(pos)
    aggs: list[Column] = []
    for i in range(len(sums)):
        aggs.append(F.sum(f"_s{i}").alias(f"_s{i}"))
    for i in range(len(lasts)):
        v = F.col(f"_l{i}")
        aggs.append(F.max_by(v, F.when(v.isNotNull(), where)).alias(f"_l{i}"))
    for i in range(len(upcoming)):
        v = F.col(f"_u{i}")
        aggs.append(F.min_by(v, F.when(v.isNotNull(), where)).alias(f"_u{i}"))
    for i in range(len(prevs)):
        aggs.append(F.max_by(f"_p{i}", pos).alias(f"_p{i}"))
    for i in range(len(nexts)):
        aggs.append(F.min_by(f"_n{i}", pos).alias(f"_n{i}"))
    for i in range(len(totals)):
        aggs.append(F.sum(f"_t{i}").alias(f"_t{i}"))
    keys = [*parts, "_chunk"]
    summary = base.groupBy(*keys).agg(*aggs)

    seq = W.partitionBy(*(parts or [F.lit(0)])).orderBy("_chunk")
    before = seq.rowsBetween(W.unboundedPreceding, -1)
    after = seq.rowsBetween(1, W.unboundedFollowing)
    whole = seq.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = [F.col(c) for c in keys]
    carried += [F.sum(f"_s{i}").over(before).alias(f"_cs{i}") for i in range(len(sums))]
    carried += [
        F.last(f"_l{i}", ignorenulls=True).over(before).alias(f"_cl{i}") for i in range(len(lasts))
    ]
    carried += [
        F.first(f"_u{i}", ignorenulls=True).over(after).alias(f"_cu{i}")
        for i in range(len(upcoming))
    ]
    carried += [F.lag(f"_p{i}").over(seq).alias(f"_cp{i}") for i in range(len(prevs))]
    carried += [F.lead(f"_n{i}").over(seq).alias(f"_cn{i}") for i in range(len(nexts))]
    carried += [F.sum(f"_t{i}").over(whole).alias(f"_ct{i}") for i in range(len(totals))]
    carry = summary.select(*carried)

    local = W.partitionBy(*keys).orderBy(pos)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    onward = local.rowsBetween(0, W.unboundedFollowing)
    out = base.join(carry, keys)
    added: dict[str, Column] = {}
    for i, name in enumerate(sums):
        added[name] = F.coalesce(F.col(f"_cs{i}"), F.lit(0)) + F.coalesce(
            F.sum(f"_s{i}").over(upto), F.lit(0)
        )
    for i, name in enumerate(lasts):
        added[name] = F.coalesce(F.last(f"_l{i}", ignorenulls=True).over(upto), F.col(f"_cl{i}"))
    for i, name in enumerate(upcoming):
        added[name] = F.coalesce(
            F.first(f"_u{i}", ignorenulls=True).over(onward), F.col(f"_cu{i}")
        )
    edge = F.lag(F.lit(1)).over(local).isNull()
    for i, name in enumerate(prevs):
        added[name] = F.when(edge, F.col(f"_cp{i}")).otherwise(F.lag(f"_p{i}").over(local))
    edge = F.lead(F.lit(1)).over(local).isNull()
    for i, name in enumerate(nexts):
        added[name] = F.when(edge, F.col(f"_cn{i}")).otherwise(F.lead(f"_n{i}").over(local))
    for i, name in enumerate(totals):
        added[name] = F.col(f"_ct{i}")
    kept = [c for c in df.columns if c not in added]
    return out.select(*kept, *(e.alias(n) for n, e in added.items()))


def islands(
    df: DataFrame, parts: Sequence[str], pos: str, key: Column,
    totals: dict[str, Column] | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Maximal runs of equal ``key``: adds ``island_start``, ``island_end`` (positions).

    ``pos`` must be dense. A chunk publishes its first and last key and its first and last
    change; runs that cross chunks are closed on those summaries, so a run of any length
    never meets in one task. ``totals`` as in ``scan``.
    """
    totals = totals or {}
    keys = [*parts, "_chunk"]
    local = W.partitionBy(*keys).orderBy(pos)
    base = df.withColumns(
        {"_chunk": chunk_of(pos, chunk_rows), "_key": F.struct(key.alias("k")),
         **{f"_t{i}": e for i, e in enumerate(totals.values())}}
    ).withColumn("_before", F.lag("_key").over(local))
    base = base.withColumn(
        "_step", F.when(F.col("_before").isNotNull() & (F.col("_before") != F.col("_key")), F.col(pos)))
    seq = W.partitionBy(*(parts or [F.lit(0)])).orderBy("_chunk")
    earlier = seq.rowsBetween(W.unboundedPreceding, -1)
    later = seq.rowsBetween(1, W.unboundedFollowing)
    whole = seq.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summary = (
        base.groupBy(*keys)
        .agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"),
             F.min_by("_key", pos).alias("_fk"), F.max_by("_key", pos).alias("_lk"),
             F.min("_step").alias("_s1"), F.max("_step").alias("_s2"),
             *[F.sum(f"_t{i}").alias(f"_t{i}") for i in range(len(totals))])
        .withColumn("_goes_on", F.coalesce(F.lag("_lk").over(seq) == F.col("_fk"), F.lit(False)))
        .withColumn("_entry", F.when(~F.col("_goes_on"), F.col("_lo")))
    )
    carry = summary.select(
        *keys,
        F.when(F.col("_goes_on"),
               F.last(F.coalesce("_s2", "_entry"), ignorenulls=True).over(earlier))
        .otherwise(F.col("_lo")).alias("_cs"),
        F.coalesce(F.first(F.coalesce("_entry", "_s1"), ignorenulls=True).over(later) - 1,
                   F.max("_hi").over(whole)).alias("_ce"),
        *[F.sum(f"_t{i}").over(whole).alias(f"_ct{i}") for i in range(len(totals))],
    )
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    onward = local.rowsBetween(1, W.unboundedFollowing)
    return base.join(carry, keys).select(
        *df.columns,
        F.coalesce(F.last("_step", ignorenulls=True).over(upto), F.col("_cs")).alias("island_start"),
        F.coalesce(F.first("_step", ignorenulls=True).over(onward) - 1, F.col("_ce")).alias("island_end"),
        *[F.col(f"_ct{i}").alias(n) for i, n in enumerate(totals)],
    )


# ---------------------------------------------------------------- greedy starts


def _next_start(x: np.ndarray, forced: np.ndarray, stride: int) -> np.ndarray:
    """Index of the start that follows a start at each row (len(x) when outside)."""
    n = len(x)
    reach = np.searchsorted(x, x + stride, side="left")
    reach = np.maximum(reach, np.arange(n) + 1)
    marks = np.where(forced, np.arange(n), n)
    after = np.minimum.accumulate(marks[::-1])[::-1]
    following = np.append(after[1:], n)
    return np.minimum(reach, following)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """Slices of equal keys out of sorted batches; the last run waits for the next batch."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        pdf = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield pdf, lo, hi
        held = pdf.iloc[cuts[-1]:]
    if held is not None:
        yield held, 0, len(held)


def _table_of(x: np.ndarray, forced: np.ndarray, stride: int) -> tuple[list[int], list[int]]:
    """How a chunk maps an incoming target to the outgoing one: entry x, outgoing target."""
    n = len(x)
    nxt = _next_start(x, forced, stride)
    leave = (x + stride).tolist()
    for j, step in zip(range(n - 1, -1, -1), nxt[::-1].tolist()):
        if step < n:
            leave[j] = leave[step]
    hits = np.flatnonzero(forced)
    stop = int(hits[0]) if len(hits) else n
    # Entry targets are at most x[0] + stride, so later rows cannot be an entry.
    cut = min(stop, int(np.searchsorted(x, x[0] + stride, side="left")) + 1)
    enter, first = np.unique(x[:cut], return_index=True)
    enter_x, exits = enter.tolist(), [leave[i] for i in first.tolist()]
    if stop < n and cut == stop:
        enter_x.append(np.iinfo(np.int64).max)
        exits.append(leave[stop])
    return enter_x, exits


def _tables(keys: list[str], stride: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for pdf, lo, hi in _runs(batches, keys):
            part = pdf.iloc[lo:hi]
            x, forced = part["_x"].to_numpy(np.int64), part["_forced"].to_numpy(bool)
            out.append((*part[keys].iloc[0].tolist(), *_table_of(x, forced, stride)))
            if len(out) >= 1024:
                yield pd.DataFrame(out, columns=[*keys, "_enter", "_leave"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*keys, "_enter", "_leave"])

    return run


def _through(enter: np.ndarray, leave: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Outgoing targets of incoming ones; a target beyond the last entry passes unchanged."""
    i = np.searchsorted(enter, targets, side="left")
    inside = i < len(enter)
    return np.where(inside, leave[np.minimum(i, len(enter) - 1)], targets)


def _compose(stride: int, first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The table of two neighbouring stretches of a sequence, as one stretch."""
    (enter, leave), (enter2, leave2) = first, then
    # Targets beyond the first table meet the second one as they came.
    more = enter2 > enter[-1]
    enter, leave = np.append(enter, enter2[more]), np.append(_through(enter2, leave2, leave), leave2[more])
    # No target reaches further than a stride past the first row.
    if enter[0] <= np.iinfo(np.int64).max - stride:
        cut = int(np.searchsorted(enter, enter[0] + stride, side="left")) + 1
        enter, leave = enter[:cut], leave[:cut]
    return enter, leave


def _merged(keys: list[str], stride: int):
    """Fold the sorted tables of each stretch into one table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, table = None, None
        for pdf in batches:
            out: list[tuple] = []
            owners = zip(*[pdf[k] for k in keys])
            for owner, enter, leave in zip(owners, pdf["_enter"], pdf["_leave"]):
                own = np.asarray(enter, np.int64), np.asarray(leave, np.int64)
                if owner != current:
                    if table is not None:
                        out.append((*current, *(t.tolist() for t in table)))
                    current, table = owner, own
                else:
                    table = _compose(stride, table, own)
            if out:
                yield pd.DataFrame(out, columns=[*keys, "_enter", "_leave"])
        if table is not None:
            yield pd.DataFrame([(*current, *(t.tolist() for t in table))], columns=[*keys, "_enter", "_leave"])

    return run


def _chain(keys: list[str], name: str):
    """Carry the target along the tables of each stretch, from the target that enters it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, current = 0, None
        for pdf in batches:
            targets = []
            owners = zip(*[pdf[k] for k in keys])
            for owner, came, enter, leave in zip(owners, pdf["_came"], pdf["_enter"], pdf["_leave"]):
                if owner != current:
                    target, current = int(came), owner
                targets.append(target)
                i = int(np.searchsorted(np.asarray(enter, np.int64), target, side="left"))
                if i < len(enter):
                    target = int(leave[i])
            yield pdf[[*keys[:-1], name]].assign(_target=targets)

    return run


def _targets(tables: DataFrame, parts: list[str], name: str, stride: int, fan: int) -> DataFrame:
    """The target that enters every stretch ``name`` of each sequence: ``parts…, name, _target``.

    A prefix scan: ``fan`` neighbouring tables are composed into one until a sequence fits into one
    stretch, then targets are handed down again, level by level. No task walks more than ``fan``
    tables of a sequence at a time, and the levels grow with the logarithm of its length.
    """
    above = f"{name}u"
    fields = {f.name: f for f in tables.schema.fields}
    part_fields = [fields[p] for p in parts]
    longs = T.ArrayType(T.LongType())
    keys = [*parts, above]
    placed = tables.withColumn(above, F.floor(F.col(name) / F.lit(fan)).cast("long"))
    if (tables.agg(F.max(name)).first()[0] or 0) < fan:
        # Nothing enters a sequence: every target is met at once.
        entered = placed.withColumn("_came", F.lit(int(np.iinfo(np.int64).min)))
    else:
        merged = cut_lineage(placed.repartition(*keys).sortWithinPartitions(*keys, name).select(
            *keys, "_enter", "_leave").mapInPandas(_merged(keys, stride), T.StructType(
                [*part_fields, T.StructField(above, T.LongType()), T.StructField("_enter", longs), T.StructField("_leave", longs)])))
        came = _targets(merged, parts, above, stride, fan).withColumnRenamed("_target", "_came")
        entered = placed.join(came, keys)
    return entered.repartition(*keys).sortWithinPartitions(*keys, name).mapInPandas(
        _chain(keys, name),
        T.StructType([*part_fields, T.StructField(name, T.LongType()), T.StructField("_target", T.LongType())]))


def _emit(keys: list[str], stride: int):
    """Jump from start to start in each chunk, from the target that enters it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goal, current = 0, None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), n]
            xs, hits = pdf["_x"].tolist(), [*np.flatnonzero(pdf["_forced"].to_numpy(bool)).tolist(), n]
            chosen, h = [], 0
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                owner = tuple(pdf[k].iat[lo] for k in keys)
                if owner != current:
                    goal, current = int(pdf["_target"].iat[lo]), owner
                at = lo
                while True:
                    h = bisect_left(hits, at, h)
                    at = min(bisect_left(xs, goal, at, hi), hits[h])
                    if at >= hi:
                        break
                    chosen.append(at)
                    goal = xs[at] + stride
                    at += 1
            yield pdf.iloc[chosen][[*keys[:-1], "_pos"]]

    return run


def greedy_starts(
    df: DataFrame,
    parts: Sequence[str],
    pos: str,
    x: Column,
    stride: int,
    eligible: Column | None = None,
    forced: Column | None = None,
    chunk_rows: int | None = None,
    fan: int = 256,
) -> DataFrame:
    """Greedy selection of group starts along each sequence.

    Walking by ``pos``: a row starts a group when it is ``forced``, or when it is ``eligible``
    and its ``x`` (LONG, non-decreasing) is at least ``x(previous start) + stride``; the first
    eligible row always starts one. Returns ``parts + pos`` of the starts.

    The walk is sequential, so every chunk first publishes how it maps the incoming target to
    the outgoing one (at most ``stride`` entries); these maps are composed in a tree of ``fan``
    children, and each chunk then emits its starts.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    parts = list(parts)
    keys = [*parts, "_chunk"]
    forced = F.lit(False) if forced is None else forced
    keep = forced if eligible is None else (forced | eligible)
    rows = (
        df.withColumn("_chunk", chunk_of(pos, chunk_rows))
        .select(*keys, F.col(pos).cast("long").alias("_pos"), x.cast("long").alias("_x"),
                forced.alias("_forced"), keep.alias("_keep"))
        .filter("_keep")
        .drop("_keep")
    )
    fields = {f.name: f for f in rows.schema.fields}
    part_fields = [fields[p] for p in parts]
    chunk_field = fields["_chunk"]
    longs = T.ArrayType(T.LongType())
    together = lambda df, by, then: df.repartition(*by).sortWithinPartitions(*by, then)
    tables = cut_lineage(together(rows, keys, "_pos").mapInPandas(
        _tables(keys, stride),
        T.StructType([*part_fields, chunk_field, T.StructField("_enter", longs),
                      T.StructField("_leave", longs)]),
    ))
    targets = _targets(tables, parts, "_chunk", stride, fan)
    starts = together(rows.join(targets, keys), keys, "_pos").mapInPandas(
        _emit(keys, stride),
        T.StructType([*part_fields, T.StructField("_pos", T.LongType())]),
    )
    return starts.withColumnRenamed("_pos", pos)


def neighbour_frame(
    df: DataFrame, parts: Sequence[str], pos: str, width: int,
    before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Sums over the ``width`` rows before / after each row (0 at the ends).

    ``pos`` must be dense. Rows within ``width`` of a chunk border are copied to the next
    chunk, so each chunk sees its whole frame.
    """
    chunk_rows = chunk_rows or CHUNK
    if not 1 <= width <= chunk_rows:
        raise ValueError("width must be between 1 and the chunk size")
    at = lambda shift: F.floor((F.col(pos) + shift) / F.lit(chunk_rows)).cast("long")
    copies = F.array_distinct(F.array(at(0), at(-width), at(width)))
    spread = df.withColumn("_home", at(0)).withColumn("_copy", F.explode(copies))
    seq = W.partitionBy(*parts, "_copy").orderBy(pos)
    for name, expr in (before or {}).items():
        total = F.sum(expr).over(seq.rowsBetween(-width, -1))
        spread = spread.withColumn(name, F.coalesce(total, F.lit(0)))
    for name, expr in (after or {}).items():
        total = F.sum(expr).over(seq.rowsBetween(1, width))
        spread = spread.withColumn(name, F.coalesce(total, F.lit(0)))
    return spread.filter("_home = _copy").drop("_home", "_copy")


def group_starts(
    df: DataFrame, parts: Sequence[str], pos: str, starts: DataFrame, name: str,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Mark every row with the position of the last start at or before it."""
    # The scan reads its input twice; the starts are few, so they are fixed first.
    marks = cut_lineage(starts.withColumn("_start", F.lit(True)))
    joined = df.join(marks, [*parts, pos], "left")
    return scan(joined, parts, pos, lasts={name: F.when(F.col("_start"), F.col(pos))},
                chunk_rows=chunk_rows).drop("_start")
