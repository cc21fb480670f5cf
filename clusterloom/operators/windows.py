"""Overlapping fixed-length windows over concatenated sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.scalar import slim_window_id
from clusterloom.functions.tokens import BLOCK, explode_blocks
from clusterloom.operators.ordered import index_rows, scan


def window_step(length: int, overlap_percent: float) -> int:
    step = length - int(overlap_percent * length / 100)
    if length < 1 or step < 1:
        raise ValueError("overlap must be below 100 percent of a positive length")
    return step


def sequence_windows(
    df: DataFrame, parts: Sequence[str], id_col: str, seq_col: str, length: int,
    overlap_percent: float, order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Full windows over the id-sorted concatenation of each part.

    ``parts…, window, ids, window_id, content``: ids of every sequence that reaches into the
    window, in order, once. Offsets come from a chunked running sum over lengths
    only; the text is cut into bounded pieces and moved once, keyed by (part, window). A window
    collects at most ``length`` characters.
    """
    step = window_step(length, overlap_percent)
    # An id may repeat, so sequences are numbered once and joined by their number.
    numbered = index_rows(df, parts, [*(order or [id_col]), F.xxhash64(seq_col)], "_at").select(*parts, "_at", id_col, seq_col)
    keys = [*parts, "_at"]
    placed = scan(
        numbered.select(*keys, F.length(seq_col).cast("long").alias("_len")), parts, "_at",
        sums={"_end": F.col("_len")}, totals={"_total": F.col("_len")},
    ).select(*keys, (F.col("_end") - F.col("_len")).alias("_off"), "_total")
    pieces = explode_blocks(
        numbered.join(placed, keys).filter(F.col("_total") >= length),
        seq_col, BLOCK,
    ).withColumn("_from", F.col("_off") + F.col("block_start"))
    low = F.greatest(F.ceil((F.col("_from") - length + 1) / step), F.lit(0)).cast("long")
    high = F.least(
        F.floor((F.col("_from") + F.length("block") - 1) / step),
        F.floor((F.col("_total") - length) / step)).cast("long")
    hits = (
        pieces.withColumns({"_lo": low, "_hi": high})
        .filter("_lo <= _hi")
        .withColumn("window", F.explode(F.sequence("_lo", "_hi")))
    )
    begin = F.greatest(F.col("window") * step - F.col("_from"), F.lit(0))
    stop = F.least(F.col("window") * step + length - F.col("_from"), F.length("block"))
    part = F.substring("block", (begin + 1).cast("int"), (stop - begin).cast("int"))
    grouped = (
        hits.select(*parts, "window", F.col("_from"), F.col(id_col).alias("_id"), part.alias("_text"))
        .groupBy(*parts, "window")
        .agg(F.array_sort(F.collect_list(F.struct("_from", "_id", "_text"))).alias("_p"))
    )
    return grouped.select(
        *parts, "window",
        F.array_distinct(F.transform("_p", lambda p: p["_id"])).alias("ids"),
        F.array_join(F.transform("_p", lambda p: p["_text"]), "").alias("content"),
    ).withColumn("window_id", slim_window_id(F.col("ids").cast("array<string>")))
