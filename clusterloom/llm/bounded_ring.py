"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 9).

Every shard owns ``vnodes`` points of a ring of ``cells``; a row belongs to the first point at or
after the hash of its id. A shard takes rows up to its capacity; what overflows goes on to the
next point clockwise until a shard has room. With ``slack`` 0 the capacities add up to the rows,
so row counts differ by at most one; a larger slack moves fewer rows when shards change.

Only counts per virtual node reach the driver (``shards * vnodes`` of them). Rows are ranked
within cells, whose number is a parameter, and equal rows are counted before and spread after, so
neither a repeated row nor a hot id fills a task.

Edge cases: a null text has size 1 and the CRC of no bytes; a null id is hashed as a value of its
own; repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clusterloom.session import cut_lineage

CELLS = 1 << 20
#: Equal rows are spread again in blocks of this many.
BLOCK = 1 << 16


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, one per cell, in ring order."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            cell = int.from_bytes(digest, "big") % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def place(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Rows ``[first, last)`` of each arc and the shard that takes them: ``(arc, first, last, shard)``.

    First every shard takes rows of its own arcs, then overflow moves on point by point.
    """
    room = list(capacity)
    taken: list[tuple[int, int, int, int]] = []
    waiting = {arc: [(arc, 0, n)] for arc, n in enumerate(counts) if n}
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for at in sorted(waiting):
            shard = owners[at]
            for arc, first, last in waiting[at]:
                fits = min(room[shard], last - first)
                if fits:
                    taken.append((arc, first, first + fits, shard))
                    room[shard] -= fits
                if first + fits < last:
                    moved.setdefault((at + 1) % len(owners), []).append((arc, first + fits, last))
        waiting = moved
    return taken


def assign(
    docs: DataFrame, shards: int, *, vnodes: int = 256, slack: float = 0.0, cells: int = CELLS
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``; slots count from 0 without gaps in a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                    F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
        .withColumn("_point", F.xxhash64("doc_id"))
        .withColumn("_cell", F.pmod("_point", F.lit(cells)))
    )
    rows = cut_lineage(rows)
    nodes = ring(shards, vnodes, cells)
    owners = [shard for _, shard in nodes]
    # Arc i ends at node i; cells after the last node belong to the first.
    spans = [(0 if i == 0 else nodes[i - 1][0] + 1, cell, i) for i, (cell, _) in enumerate(nodes)]
    if nodes[-1][0] + 1 < cells:
        spans.append((nodes[-1][0] + 1, cells - 1, 0))
    arcs = spark.createDataFrame(spans, "_from long, _to long, _arc int")
    arc_of = arcs.select("_arc", F.explode(F.sequence("_from", "_to")).alias("_cell"))
    by_cell = rows.groupBy("_cell").agg(F.sum("_n").alias("_in"))
    before = F.sum("_in").over(W.partitionBy("_arc").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    cell_base = by_cell.join(arc_of, "_cell").withColumn("_base", F.coalesce(before, F.lit(0)))

    counts = [0] * len(nodes)
    for r in cell_base.groupBy("_arc").agg(F.sum("_in").alias("n")).collect():  # at most one per node
        counts[r["_arc"]] = r["n"]
    total = sum(counts)
    if slack:
        capacity = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    pieces = []
    for arc, first, last, shard in sorted(place(counts, owners, capacity)):
        pieces.append((arc, first, last, shard, used[shard]))
        used[shard] += last - first
    table = spark.createDataFrame(pieces, "_arc int, _first long, _last long, shard int, _slot long")

    within = F.sum("_n").over(
        W.partitionBy("_cell").orderBy("_point", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1))
    ranked = (
        rows.join(cell_base.select("_cell", "_arc", "_base"), "_cell")
        .withColumn("_rank", F.col("_base") + F.coalesce(within, F.lit(0)))
        .select("doc_id", "size", "text_crc32", "_arc", "_rank", "_n")
    )
    blocks = ranked.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK)))
    ).repartition("_arc", "_rank", "_block")
    single = blocks.withColumn("_i", F.explode(F.sequence(
        F.col("_block") * BLOCK, F.least((F.col("_block") + 1) * BLOCK, F.col("_n")) - 1)))
    single = single.withColumn("_rank", F.col("_rank") + F.col("_i"))
    return (
        single.join(table, "_arc").filter("_rank >= _first and _rank < _last")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))
    )


def owner_of(cell: int, nodes: list[tuple[int, int]]) -> int:
    """Index of the first node at or after a cell, clockwise."""
    return bisect.bisect_left([c for c, _ in nodes], cell) % len(nodes)
