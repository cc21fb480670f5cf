"""Inputs that grow: every run handles exactly the files that came since the last one.

A file stream keeps the names of handled files in its state folder and the file sink keeps a log of
finished outputs, so a run that is broken off and started again neither loses nor repeats a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def ingest(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Append what a stream of new files yields to the Parquet folder ``out``; all rows written so far.

    ``stream`` comes from a reader called with ``stream=True`` and any row-wise steps; ``state`` belongs
    to this pair of input and output alone. Files are judged by name: a changed file is not read again.
    A run without new files writes nothing; both folders must be shared by all executors.
    """
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
