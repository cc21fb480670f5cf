"""Byte-level BPE encoding and decoding (operator 1).

A text longer than ``chunk_chars`` is cut into overlapping chunks that are pre-tokenised in
parallel. Two neighbouring chunks resynchronise at the first position of their overlap that both
see as the start of a pre-token: the pattern never looks behind, so from there on both agree. The
pieces between those positions are encoded in parallel and concatenated. A shorter text is one
chunk and has nothing to stitch. Decoding concatenates the bytes of the ids.

Edge cases: a null text counts as empty and has no ids; repeated rows and repeated or null ids
are encoded row by row (equal long texts once); other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clusterloom.llm.common import by_value, released, small_batches

by_value(__name__)

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: Characters after a match that can still change it (a contraction has three).
LOOKAHEAD = 2


def read_ranks(path: str) -> bytes:
    """The rank file's content: bounded by the vocabulary, so it travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: One encoder per task; on the driver it stays empty.
_ENCODERS: dict = {}


def _encoder(content: bytes, pattern: str):
    import tiktoken

    if pattern not in _ENCODERS:
        _ENCODERS[pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=parse_ranks(content), special_tokens={})
    return _ENCODERS[pattern]


def _ids(encoder, text: str) -> bytes:
    return encoder.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def chunk_bounds(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping chunks of a text of ``n`` characters."""
    count = max(1, -(-n // chunk))
    return [(i * chunk, min(n, (i + 1) * chunk + overlap)) for i in range(count)]


def boundaries(body: str, start: int, compiled, last: bool) -> tuple[list[int], bool]:
    """Starts of pre-tokens of one chunk that later text cannot change, and whether the chunk
    holds a place that is a start whatever stands before it (a space after a non-space)."""
    found = [0]
    sure = False
    limit = len(body) if last else len(body) - LOOKAHEAD
    for m in compiled.finditer(body):
        end = m.end()
        if end > limit or (end == len(body) and not last):
            break
        found.append(end)
        sure = sure or (end < len(body) and body[end].isspace() and not body[end - 1].isspace())
    return [start + p for p in found], sure


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, ids)``; ``ids`` is little-endian unsigned 32-bit binary."""
    content = read_ranks(ranks_path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content, pattern)
        for batch in small_batches(batches):
            ids = [_ids(encoder, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    is_long = F.length("text") > chunk_chars
    short = rows.filter(~is_long).mapInArrow(whole, f"doc_id {id_type}, ids binary")
    keyed = rows.filter(is_long).select("doc_id", "text", F.sha2("text", 256).alias("_key"))
    encoded = _encode_long(
        keyed.select("_key", "text"), content, pattern, chunk_chars, overlap_chars
    )
    return short.unionByName(keyed.select("doc_id", "_key").join(encoded, "_key").select("doc_id", "ids"))


def _encode_long(
    texts: DataFrame, content: bytes, pattern: str, chunk_chars: int, overlap_chars: int
) -> DataFrame:
    """``(_key, text)`` to one row ``(_key, ids)`` per key, by chunks, stitches and pieces."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["_key"], frame["text"]):
                bounds = chunk_bounds(len(text), chunk_chars, overlap_chars)
                for i in range(0, len(bounds), 64):
                    part = bounds[i:i + 64]
                    yield pd.DataFrame({
                        "_key": key, "_chunk": range(i, i + len(part)), "_start": [a for a, _ in part],
                        "_last": [i + j + 1 == len(bounds) for j in range(len(part))],
                        "_body": [text[a:b] for a, b in part]})

    chunks = texts.mapInPandas(
        cut, "_key string, _chunk long, _start long, _last boolean, _body string"
    ).dropDuplicates(["_key", "_chunk"])

    def tokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        compiled = regex.compile(pattern)
        for f in frames:
            head, tail, sure = [], [], []
            for start, last, body in zip(f["_start"], f["_last"], f["_body"]):
                found, known = boundaries(body, start, compiled, last)
                head.append([p for p in found if p < start + overlap_chars])
                tail.append([p for p in found if p >= start + chunk_chars])
                sure.append(known or start == 0)
            yield pd.DataFrame({"_key": f["_key"], "_chunk": f["_chunk"], "_head": head, "_tail": tail,
                                "_sure": sure})

    seen = chunks.mapInPandas(
        tokenise, "_key string, _chunk long, _head array<long>, _tail array<long>, _sure boolean")
    order = W.partitionBy("_key").orderBy("_chunk")
    # A chunk whose own tail may be out of step cannot vouch for the next one.
    sync = F.when(F.lag("_sure").over(order), F.array_min(F.array_intersect("_head", F.lag("_tail").over(order))))
    stitched = (
        seen.withColumn("_sync", F.when(F.col("_chunk") == 0, F.lit(0).cast("long")).otherwise(sync))
        .withColumn("_run", F.sum(F.col("_sync").isNotNull().cast("long")).over(order))
    )
    stitched = stitched.select(
        "_key", "_chunk", "_run", F.max("_sync").over(W.partitionBy("_key", "_run")).alias("_from"),
        F.lead("_sync").over(order).alias("_next"))

    def encode_run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_chunk")
        encoder = _encoder(content, pattern)
        begin, end = int(frame["_from"].iloc[0]), frame["_next"].iloc[-1]
        text, at = "", begin
        for start, body in zip(frame["_start"], frame["_body"]):
            text += body[at - start:]
            at = start + len(body)
        if not pd.isna(end):
            text = text[: int(end) - begin]
        return pd.DataFrame({"_key": [frame["_key"].iloc[0]], "_run": [frame["_run"].iloc[0]],
                             "_ids": [_ids(encoder, text)]})

    pieces = (
        chunks.drop("_last").join(stitched, ["_key", "_chunk"])
        .groupBy("_key", "_run").applyInPandas(encode_run, "_key string, _run long, _ids binary")
    )

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_run")
        return pd.DataFrame({"_key": [frame["_key"].iloc[0]], "ids": [b"".join(frame["_ids"])]})

    return pieces.groupBy("_key").applyInPandas(fold, "_key string, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``; a null ``ids`` decodes to no bytes."""
    content = read_ranks(ranks_path)
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ranks = parse_ranks(content)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        take = table.__getitem__
        for batch in small_batches(batches):
            out = [b"".join(map(take, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), f"doc_id {id_type}, ids binary, decoded binary")
