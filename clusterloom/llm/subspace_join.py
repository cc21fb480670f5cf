"""Near-duplicate vectors by a subspace pigeonhole join (operator 4).

Unit vectors with cosine ``c`` or more lie within squared distance ``2 - 2c``. After one fixed
rotation, which spreads the distance evenly, the dimensions are split into blocks of ``block_dims``;
for a pair that near, some block's squared distance stays within the block's share of the budget.
Each block is range-joined: vectors fall into cells whose side is twice the block's radius, and a
vector looks into its own cell and those neighbours that its radius reaches, one direction per
pair of cells. The union of the blocks' candidates is verified by cosine in double precision.

Equal vectors of one label are one node with a weight, so copies make no pairs. Joins are plain
equi-joins on the cell, which the skew join can split.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component, and those
with a null label, link with nothing; vectors of different lengths are not compared; repeated rows
count as other vectors; a null ``vec_id`` names no component unless no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import by_value, components, hold
from clusterloom.llm.words import mix

by_value(__name__)

COSINE, BLOCK_DIMS, SEED = 0.98, 8, 20
#: Room for rounding in the rotated coordinates; verification is exact.
SLACK = 1e-6


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int, block_dims: int) -> list[np.ndarray]:
    return np.array_split(np.arange(d), max(1, -(-d // block_dims)))


def cells(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, own, cell hash) of every vector's own cell and of the reachable neighbours that
    come after it in the order of cells."""
    side = 2 * radius * (1 + SLACK)
    at = np.floor(x / side)
    offset = x - at * side
    toward = np.where(offset * 2 >= side, 1, -1)
    gap = np.minimum(offset, side - offset)
    k = x.shape[1]
    subsets = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(bool)
    reach = (gap ** 2) @ subsets.T <= radius * radius * (1 + SLACK)
    first = np.where(subsets.any(axis=1), subsets.argmax(axis=1), 0)
    reach &= (toward[:, first] > 0) | ~subsets.any(axis=1)
    row, which = np.nonzero(reach)
    cell = at[row].astype(np.int64) + subsets[which] * toward[row]
    places = mix(np.arange(3, 3 + k, dtype=np.uint64)) | np.uint64(1)
    return row, which == 0, mix((cell.astype(np.uint64) * places).sum(axis=1, dtype=np.uint64))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by vector length; the column holds valid vectors only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[begin[rows][:, None] + np.arange(d)]


def links(nodes: DataFrame, cosine: float, block_dims: int) -> DataFrame:
    """``(node, label, embedding)`` of valid vectors to links ``(a, b)``."""
    budget = 2 - 2 * cosine

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = batch.column(0).to_numpy()
                label = batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
                for rows, x in _matrices(batch.column(2)):
                    d = x.shape[1]
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(d)
                    for b, dims in enumerate(blocks(d, block_dims)):
                        y = np.ascontiguousarray(x[:, dims])
                        row, own, cell = cells(y, np.sqrt(budget * len(dims) / d))
                        key = mix(cell + mix(label[rows][row] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d * 4096 + b)))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key.view(np.int64)), pa.array(ids[rows][row]), pa.array(own), pa.array(np.full(len(row), budget * len(dims) / d)),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * len(dims) + 1, len(dims)), pa.int32()), pa.array(y[row].ravel())),
                        ], ["cell", "node", "own", "budget", "x"])

    placed = nodes.select("node", "label", "embedding").mapInArrow(
        scatter, "cell long, node long, own boolean, budget double, x array<double>")
    other = placed.filter("own").select("cell", F.col("node").alias("b"), F.col("x").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    candidates = placed.join(other, "cell").filter(
        (~F.col("own") | (F.col("b") < F.col("node"))) & (F.col("node") != F.col("b")) & (apart <= F.col("budget") * (1 + SLACK) + 1e-12)
    ).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            left = dict((r, v) for rows, m in _matrices(batch.column(2)) for r, v in zip(rows, m))
            for rows, y in _matrices(batch.column(3)):
                x = np.array([left[r] for r in rows])
                value = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                ok[rows] = value >= cosine
            take = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    vectors = nodes.select("node", "embedding")
    full = (
        candidates.join(vectors.withColumnsRenamed({"node": "a", "embedding": "x"}), "a")
        .join(vectors.withColumnsRenamed({"node": "b", "embedding": "y"}), "b").select("a", "b", "x", "y")
    )
    return full.mapInArrow(verify, "a long, b long")


def cluster(embeddings: DataFrame, *, cosine: float = COSINE, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    v = F.col("embedding")
    fine = (
        F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = embeddings.select(
        "vec_id", "label", "embedding", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "embedding")).alias("node"))
    nodes = hold(rows.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("m"), F.min("vec_id").alias("name")))
    found = hold(links(nodes, cosine, block_dims))
    weight = nodes.select("node", "m")
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(weight.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("n"))
    member = nodes.select("node", "m", "name").join(others, "node", "left").join(components(found), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = member.groupBy("component").agg(F.min("name").alias("component_id"))
    per_node = member.join(names, "component").select(
        "node", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id")
    alone = F.col("node").isNull()
    return rows.select("vec_id", "node").join(per_node, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
