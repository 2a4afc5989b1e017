"""Append-only audit sink for a stream of trail entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from docreg.sources.registry import audit_projection


def audit_sink(entries: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that redacts and appends; call ``.start()`` on it.

    Stateless, so the batch projection is used unchanged. ``checkpoint`` is the
    query's progress folder and must be shared storage.
    """
    return (
        audit_projection(entries).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
