"""Chat formatting with rotated perspectives (operator 2).

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the
assistant and every other speaker as a named user; a mask marks the assistant's words. Roles in
``context_roles`` (system messages) are no participants: they stand in every rendering as they are.

One turn is one message ``<|user|>name\\ntext<|end|>\\n`` or ``<|assistant|>\\ntext<|end|>\\n``;
the trained span is the text with its end mark. Marks inside a text are escaped, so a text cannot
forge a turn. Messages are numbered by a distributed sort and gathered in pieces of
``piece_turns``, so a conversation of any length never meets in one task; a shorter one is one
piece. Offsets count characters of the piece.

Edge cases: a null text is an empty message; a null role is the participant ``unknown``; turns are
ordered by turn (null first), role and text, so ties and repeated rows have a fixed place and all
are rendered; a null ``conv_id`` is a conversation of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.ordered import index_rows

CONTEXT_ROLES = ("system",)
PIECE_TURNS = 64
END = "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(conversations: DataFrame, *, context_roles: Sequence[str] = CONTEXT_ROLES, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """``conv_id, assistant, piece, n_turns, n_participants, text, mask`` per conversation and
    participant; ``mask`` is an array of ``(start, end)`` of the characters to train on."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.col("conv_id").isNull().alias("_none"), "conv_id",
        F.coalesce("role", F.lit("unknown")).alias("_who"), escape(F.coalesce("text", F.lit(""))).alias("_text"),
        F.col("turn").alias("_turn"))
    placed = index_rows(rows, ["_none", "_conv"], ["_turn", "_who", "_text"], name="_pos")
    placed = placed.withColumn("piece", F.floor(F.col("_pos") / piece_turns).cast("long"))
    speaker = ~F.col("_who").isin(list(context_roles))
    people = placed.filter(speaker).select("_none", "_conv", F.col("_who").alias("assistant")).distinct()
    counted = people.groupBy("_none", "_conv").agg(F.count("*").alias("n_participants"))
    views = placed.join(people, ["_none", "_conv"])
    mine = F.col("_who") == F.col("assistant")
    head = (
        F.when(mine, F.lit("<|assistant|>\n")).when(speaker, F.concat(F.lit("<|user|>"), escape(F.col("_who")), F.lit("\n")))
        .otherwise(F.concat(F.lit("<|"), F.col("_who"), F.lit("|>\n"))))
    message = F.struct(
        "_pos", F.concat(head, F.col("_text"), F.lit(END + "\n")).alias("t"), F.length(head).alias("h"),
        (F.length("_text") + len(END)).alias("s"), mine.alias("m"))
    pieces = views.groupBy("_none", "_conv", "assistant", "piece").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(message)).alias("_m"))
    # Running offsets over at most ``piece_turns`` messages.
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    folded = F.aggregate("_m", empty, lambda acc, m: F.struct(
        (acc["at"] + F.length(m["t"])).alias("at"),
        F.when(m["m"], F.array_append(acc["mask"], F.struct((acc["at"] + m["h"]).alias("start"), (acc["at"] + m["h"] + m["s"]).alias("end"))))
        .otherwise(acc["mask"]).alias("mask")))["mask"]
    return pieces.join(counted, ["_none", "_conv"]).select(
        F.col("conv_id").cast(kind).alias("conv_id"), "assistant", "piece", F.size("_m").cast("long").alias("n_turns"), "n_participants",
        F.array_join(F.transform("_m", lambda m: m["t"]), "").alias("text"), folded.alias("mask"))
