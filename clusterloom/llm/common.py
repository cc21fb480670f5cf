"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Let a module's task functions travel by value: workers need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def small_batches(batches, rows: int = 512):
    """Cut record batches, so that a task holds the Python objects of few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def released(run):
    """``run``, a function of record batches, that gives the memory it freed back to the system when
    a task ends: workers live on, and what they keep counts against the executor."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return task


def buffers(batch, columns) -> list:
    """Rows of binary columns as views of a record batch's own memory."""
    import numpy as np

    out = []
    for c in columns:
        column = batch.column(c)
        _, where, data = column.buffers()
        ends = np.frombuffer(where, np.int32)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out.append([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    return out


def fenced(df: DataFrame, *needed: str):
    """``df`` with all columns but the ``needed`` ones under names that operators do not use, and a
    function that gives a result its old columns back, in their old order, and drops all others."""
    old = df.columns
    new = [c if c in needed else f"_other_{i}" for i, c in enumerate(old)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{n}`").alias(o) for n, o in zip(new, old)])

    return df.toDF(*new), back


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_crc32(value: Column) -> Column:
    """CRC32 of a string's UTF-8 bytes as an unsigned long."""
    return F.crc32(value.cast("string").cast("binary")).cast("long")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of links ``(a, b)``: rows ``(node, component)``, the smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to
    its smallest neighbour, then every node hands its smaller neighbours to the smallest of
    them. Only aggregates and equi-joins are used, so a node with very many links is combined
    on the map side and split by the skew join. Each round is cut by a reliable checkpoint.
    Nodes without a link to another node are not returned.
    """
    from clusterloom.session import cut_lineage

    edges = cut_lineage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut_lineage(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise rounds")
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return member.unionByName(roots)


def short_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of a record batch between Spark and Python, as rows may hold long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(key, str(size))
    number = int("".join(c for c in now if c.isdigit() or c == "-") or size)
    if not 0 < number <= size:
        spark.conf.set(key, str(size))


def stage_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for tables that later stages read again."""
    import uuid

    from clusterloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def hold(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, size is known."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
