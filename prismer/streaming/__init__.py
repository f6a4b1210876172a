"""Reads that arrive as a stream, aligned against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prismer.operators import align
from prismer.operators.index import Index
from prismer.sources.formats import json_lines


def align_stream(reads: DataFrame, index: Index, path: str, threshold: float, denominator: str = "all", checkpoint: str | None = None):
    """Start a query that writes JSON lines of each micro-batch of (query_idx, name, seq) to path/batch=<n>; a repeated batch overwrites its own."""

    def one(batch: DataFrame, number: int) -> None:
        rows = align.records(batch, align.threshold(index, batch, threshold, denominator))
        json_lines(rows).write.mode("overwrite").text(f"{path}/batch={number}")

    writer = reads.writeStream.foreachBatch(one)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
