"""Joined texts of any length as ordered pieces of bounded size.

A group's texts, one after the other, are a sequence that may be longer than a value may be. It is
kept as rows ``parts…, piece, offset, text``: piece ``i`` holds the characters from ``i`` times the
piece size on. Offsets come from a chunked running sum over lengths alone; texts are cut into
bounded blocks before they are shuffled, and every piece is put together by itself, so a group
with a third of all text spreads over as many tasks as it has pieces.

``parts`` are the (non-null) columns naming the group; none may be called ``piece``, ``offset`` or
``text``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.ordered import scan
from clusterloom.session import cut_lineage

PIECE = 1 << 20
_BLOCK = 1 << 16


def _put_together(fragments: DataFrame, keys: Sequence[str], order: str, text: str):
    """Texts of equal keys in ``order``; their lengths together are bounded by the caller."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("text"))


def joined_pieces(
    rows: DataFrame, parts: Sequence[str], pos: str, text: str, piece: int = PIECE
) -> DataFrame:
    """The texts of every group joined by ``pos``: ``parts…, piece, offset, text``.

    ``pos`` is LONG and unique within a group. Null texts count as empty; a group without any
    character has one empty piece. All pieces but the last have ``piece`` characters.
    """
    if piece < 1:
        raise ValueError("piece must be positive")
    parts = list(parts)
    block = min(piece, _BLOCK)
    body = rows.select(*parts, F.col(pos).cast("long").alias("_pos"), F.coalesce(text, F.lit("")).alias("_text"))
    # The running sum reads its input twice: narrow rows are fixed first.
    sizes = cut_lineage(body.select(*parts, "_pos", F.char_length("_text").cast("long").alias("_n")))
    begins = scan(sizes.filter("_n > 0"), parts, "_pos", sums={"_upto": F.col("_n")}).select(
        *parts, "_pos", (F.col("_upto") - F.col("_n")).alias("_begin"))
    # One regex pass is linear in the text; substrings at growing positions are not.
    blocks = body.filter("_text <> ''").select(*parts, "_pos", F.posexplode(
        F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("_i", "_part"))
    placed = blocks.join(begins, [*parts, "_pos"]).withColumn("_at", F.col("_begin") + F.col("_i") * F.lit(block))
    # A block is no longer than a piece, so it lies in one or in two neighbouring ones.
    first = F.floor(F.col("_at") / F.lit(piece)).cast("long")
    room = ((first + 1) * F.lit(piece) - F.col("_at")).cast("int")
    fragments = placed.select(*parts, F.explode(F.array(
        F.struct(first.alias("piece"), F.col("_at").alias("at"), F.substring("_part", F.lit(1), room).alias("text")),
        F.struct((first + 1).alias("piece"), ((first + 1) * F.lit(piece)).alias("at"),
                 F.substring("_part", room + 1, F.lit(block)).alias("text")),
    )).alias("_f")).select(*parts, "_f.*").filter("text <> ''")
    pieces = _put_together(fragments, [*parts, "piece"], "at", "text")
    empty = sizes.groupBy(*parts).agg(F.sum("_n").alias("_n")).filter("_n = 0").select(
        *parts, F.lit(0).cast("long").alias("piece"), F.lit("").alias("text"))
    return pieces.unionByName(empty).select(*parts, "piece", (F.col("piece") * F.lit(piece)).alias("offset"), "text")


def piece_digests(pieces: DataFrame, parts: Sequence[str], fan: int = 1024) -> DataFrame:
    """Length and digest of every group without joining it: ``parts…, n_chars, n_pieces, digest``.

    The digest is the root of a hash tree: a piece's node is the SHA-256 of its text, ``fan``
    neighbouring nodes make the SHA-256 of their digests in order, a lone node moves up as it is. It
    depends on the text, the piece size and ``fan`` alone; the levels grow with the logarithm of
    the longest group.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    parts = list(parts)
    level = cut_lineage(pieces.select(
        *parts, F.col("piece").alias("_node"), F.char_length("text").cast("long").alias("n_chars"),
        F.lit(1).cast("long").alias("n_pieces"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    # Pieces of a group are numbered from 0 without gaps, so the highest number tells the depth.
    highest = level.agg(F.max("_node")).first()[0] or 0
    while highest:
        own = F.array_sort(F.collect_list(F.struct("_node", "digest")))
        level = (
            level.groupBy(*parts, F.floor(F.col("_node") / F.lit(fan)).cast("long").alias("_up"))
            .agg(F.sum("n_chars").alias("n_chars"), F.sum("n_pieces").alias("n_pieces"), own.alias("_own"))
            .select(*parts, F.col("_up").alias("_node"), "n_chars", "n_pieces",
                    F.when(F.size("_own") == 1, F.col("_own")[0]["digest"]).otherwise(F.sha2(F.array_join(
                        F.transform("_own", lambda e: e["digest"]), "").cast("binary"), 256)).alias("digest"))
        )
        highest //= fan
    return level.drop("_node")


def region_texts(
    pieces: DataFrame, parts: Sequence[str], regions: DataFrame, region_id: str, piece: int = PIECE
) -> DataFrame:
    """Text of the regions ``parts…, region_id, begin, end`` (``end`` exclusive): ``region_id, text``.

    A region meets only the pieces it touches, by equality of the piece number. What lies outside
    the group's text is left out; an empty region, or one of an unknown group, has no text and
    is returned with an empty one. Region ids are unique.
    """
    parts = list(parts)
    clipped = F.greatest("begin", F.lit(0))
    touched = regions.filter(F.col("end") > clipped).select(
        *parts, region_id, clipped.alias("_from"), F.col("end").alias("_to"),
        F.explode(F.sequence(F.floor(clipped / F.lit(piece)), F.floor((F.col("end") - 1) / F.lit(piece)))).alias("piece"))
    low = F.greatest(F.col("_from") - F.col("offset"), F.lit(0)).cast("int")
    high = F.least(F.col("_to") - F.col("offset"), F.lit(piece)).cast("int")
    cuts = touched.join(pieces, [*parts, "piece"]).select(
        region_id, "piece", F.substring("text", low + 1, high - low).alias("_cut"))
    texts = _put_together(cuts, [region_id], "piece", "_cut")
    return regions.select(region_id).join(texts, region_id, "left").select(
        region_id, F.coalesce("text", F.lit("")).alias("text"))
