"""Queries over the test tables, each with the equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from clusterloom.sources.readers import spread

    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Text is expensive per row, and the test tables are single-split files.
    return spread(df) if name == "documents" else df


def load_all() -> None:
    from clusterloom.bindings import (  # noqa: F401
        corpus, datasets, evaluation, features, files, learning, ordering, policy, proteins, scalars, stages,
    )
