"""Records that span many splits: sequences of any length as pieces of bounded size.

Files are read line by line, so a record may begin in one split and end many splits later. Every
split first says in one row how it changes what is carried from line to line: records begun,
whether sequence lines follow, characters since the last begin. Windows over these rows give each
split its incoming state, and a second pass emits the records' text, cut at multiples of the piece
size. No value is larger than a piece or a line, and no task reads more than its splits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Per format: prefixes that begin a record, give its id, begin and end its sequence lines; what is
#: dropped from sequence lines; whether they are upper-cased.
FORMATS = {
    "fasta": ((">",), (">",), (">",), (), r"\s", False),
    "genbank": (("LOCUS",), ("VERSION",), ("ORIGIN",), ("LOCUS", "//"), r"[0-9\s]", True),
}


def _lines(spark: SparkSession, path: str, ext: str | None) -> DataFrame:
    """``file, block, _at, line``: ordered by ``block`` and ``_at`` within a file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", f"*.{ext}") if ext else reader
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))


def _any(lines: pa.Array, prefixes: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(lines), bool)
    for p in prefixes:
        out |= pc.starts_with(lines, p).to_numpy(zero_copy_only=False)
    return out


class _Batch:
    """Lines of one split (or a part of it): where records and sequence lines begin and end."""

    def __init__(self, lines: pa.Array, form: tuple, on: bool | None) -> None:
        begin, name, start, stop, drop, upper = form
        self.begins, self.names = _any(lines, begin), _any(lines, name)
        starts, stops = _any(lines, start), _any(lines, stop)
        event = starts | stops
        n = len(lines)
        last = np.maximum.accumulate(np.where(event, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        #: Lines before the first event continue what was before them.
        self.head = last < 0
        self.on = np.where(self.head, bool(on), starts[np.maximum(last, 0)] if n else False) & ~event & ~self.names
        self.mode = None if n == 0 or last[-1] < 0 else bool(starts[last[-1]])
        self.lines, self.drop, self.upper = lines, drop, upper

    def text(self) -> pa.Array:
        text = pc.replace_substring_regex(self.lines, self.drop, "")
        return pc.utf8_upper(text) if self.upper else text

    def sizes(self) -> np.ndarray:
        return np.where(self.on, pc.utf8_length(self.text()).to_numpy(zero_copy_only=False), 0).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that lie in one split."""
    if not batch.num_rows:
        return
    block = batch.column(1).to_numpy()
    file = pc.dictionary_encode(batch.column(0)).indices.to_numpy()
    cut = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])))
    for a, b in zip(cut, np.append(cut[1:], batch.num_rows)):
        yield batch.column(0)[int(a)].as_py(), int(block[a]), batch.slice(int(a), int(b - a))


def _summaries(lines: DataFrame, form: tuple) -> DataFrame:
    """One row per split: ``file, block, begun, head, rest, mode``.

    ``head`` counts characters before the first event, which belong to a sequence only if one is
    under way; ``rest`` those after it, or after the last begin if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, head, rest, mode = None, 0, 0, 0, None

        def row():
            return pa.RecordBatch.from_pydict(
                {"file": pa.array([now[0]]), "block": pa.array([now[1]], pa.int64()), "begun": pa.array([begun], pa.int64()),
                 "head": pa.array([head], pa.int64()), "rest": pa.array([rest], pa.int64()), "mode": pa.array([mode], pa.bool_())})

        for batch in batches:
            for file, block, part in _runs(batch):
                if (file, block) != now:
                    if now is not None:
                        yield row()
                    now, begun, head, rest, mode = (file, block), 0, 0, 0, None
                b = _Batch(part.column(3), form, True if mode is None else mode)
                size = b.sizes()
                first = b.head if mode is None else np.zeros(len(size), bool)
                head += int(size[first].sum())
                at = np.flatnonzero(b.begins)
                if len(at):
                    begun += len(at)
                    rest = int(size[at[-1]:].sum())
                else:
                    rest += int(size[~first].sum())
                mode = b.mode if b.mode is not None else mode
        if now is not None:
            yield row()

    return lines.mapInArrow(run, "file string, block long, begun long, head long, rest long, mode boolean")


def _carried(summaries: DataFrame) -> DataFrame:
    """What each split takes over: ``file, block, _record, _on, _offset``; one row per split."""
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    state = summaries.withColumns({
        "_record": F.coalesce(F.sum("begun").over(before), F.lit(0)),
        "_on": F.coalesce(F.last("mode", ignorenulls=True).over(before), F.lit(False)),
        "_group": F.sum((F.col("begun") > 0).cast("int")).over(order),
    }).withColumn("_own", F.col("rest") + F.when((F.col("begun") == 0) & F.col("_on"), F.col("head")).otherwise(0))
    total = F.sum("_own").over(W.partitionBy("file", "_group").orderBy("block"))
    return state.withColumn("_total", total).select(
        "file", "block", "_record", "_on", F.coalesce(F.lag("_total").over(order), F.lit(0)).alias("_offset"))


_OUT = "file string, record long, name string, start long, text string"


def read_pieces(spark: SparkSession, path: str, ext: str | None, form: str = "fasta", piece: int = 1 << 20) -> DataFrame:
    """``file, record, seq_id, piece, text``: each record's sequence in pieces of ``piece`` characters.

    ``record`` numbers the records of a file from 0; a record without sequence has no piece. For
    ``genbank`` the sequence is that of the ORIGIN lines and the id that of VERSION.
    """
    kind = FORMATS[form]
    lines = _lines(spark, path, ext)
    state = _carried(_summaries(lines, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            for file, block, part in _runs(batch):
                if (file, block) != now:
                    now = (file, block)
                    record, on, offset = (part.column(c)[0].as_py() for c in (4, 5, 6))
                    record -= 1
                b = _Batch(part.column(3), kind, on)
                for i in np.flatnonzero(b.names):
                    word = part.column(3)[int(i)].as_py()
                    word = word[1:] if form == "fasta" else word.partition(" ")[2]
                    out.append((file, record + int(b.begins[:i + 1].sum()), (word.split() or [""])[0], None, None))
                cut = np.append(np.append(0, np.flatnonzero(b.begins)), len(b.begins))
                text = b.text()
                live = pa.array(b.on)
                for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if k:
                        record, offset = record + 1, 0
                    joined = "".join(text.slice(x, y - x).filter(live.slice(x, y - x)).to_pylist())
                    at = 0
                    while at < len(joined):
                        end = at + piece - offset % piece
                        out.append((file, record, None, offset, joined[at:end]))
                        offset += len(joined[at:end])
                        at = end
                on = b.mode if b.mode is not None else on
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                    ["file", "record", "name", "start", "text"])

    found = lines.join(state, ["file", "block"]).select("file", "block", "_at", "line", "_record", "_on", "_offset").sortWithinPartitions(
        "file", "block", "_at").mapInArrow(run, _OUT)
    names = found.filter("name IS NOT NULL").groupBy("file", "record").agg(F.first("name").alias("seq_id"))
    # A piece's parts come from one batch or from neighbours; together they are no longer than it.
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    pieces = found.filter("name IS NULL").groupBy("file", "record", F.floor(F.col("start") / piece).cast("long").alias("piece")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return pieces.join(names, ["file", "record"], "left").select("file", "record", "seq_id", "piece", "text")
