"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.llm import bpe
from prismer.llm.common import modest, tidy

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: ORC lays each column out in stripes with run-length encoded integers; every row group of
#: orc.row.index.stride rows has minima, maxima and a Bloom filter of doc_id.
LAYOUT = {"orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(8 << 20), "compression": "zstd"}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write every document's ids and end_id to ORC files at path, in ascending doc_id order across files.

    Null text is empty (only the end id); null doc_ids come first; repeated rows are each written,
    in any order among themselves; an empty table gives an empty folder of files; other columns are
    ignored. One shuffle, of the texts by ranges of doc_id; the encoding follows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, flat, ends in bpe.encoder(tokenizer).slices(batch.column(1)):
                k = len(ends)
                values = np.insert(flat.view("<i4"), ends, end_id)
                places = np.append(0, ends + np.arange(1, k + 1))
                n = np.diff(places)
                starts = start + places[:-1]
                start += int(places[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, k), pa.array(np.full(k, part, np.int32)), pa.array(starts), pa.array(n), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    modest(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(tidy(run), SCHEMA).write.options(**LAYOUT).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole store), n_tokens and ids.

    Filters on doc_id reach the files' row indexes and Bloom filters. The files' totals, a number
    for each file, are added up on the driver.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    base, starts = 0, []
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts.append((part, base))
        base += n
    bases = spark.createDataFrame(starts, "part int, base long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from a store that was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, raw = ids.offsets.to_pylist(), memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64())
            n = pa.array([b - a for a, b in zip(at, at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    modest(stored.sparkSession)
    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
