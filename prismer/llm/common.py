"""Helpers shared by the training-data operators: shared storage, components, cached tokenisation."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The session's setting of the bytes of an Arrow batch, and what Python workers beside a small heap can hold several of.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest(spark: SparkSession) -> None:
    """Let Arrow batches have BATCH_BYTES instead of Spark's default of 64 MB; a smaller setting stays."""
    now = spark.conf.get(BATCH)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where df has columns of such names (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Give freed memory back at the end of a task: workers are used again, and those of other operators need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with memory given back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def parts(batches: Iterator[pa.RecordBatch], most: int = 2_000_000, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of their column number `text` have at most `most` bytes (one row at least)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
    release()


def blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by their first columns, one batch for each value of these."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield joined()
            held = []
        cuts = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        a = 0
        for b in cuts:
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield joined()
                held = []
            a = b
    if held:
        yield joined()


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unordered pairs of different numbers, each once, the smaller first."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    use = lo < hi
    order = np.lexsort((hi[use], lo[use]))
    both = np.stack([lo[use][order], hi[use][order]])
    new = np.ones(both.shape[1], bool)
    new[1:] = (both[:, 1:] != both[:, :-1]).any(0)
    return both[:, new]


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where a session on one machine has no such setting (tests) a local folder is used; on a cluster
    that is an error, as executors would not see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="prismer-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/prismer-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files below a frame made by saved(), once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(parent)
        p.getFileSystem(conf).delete(p, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges as (node, root), root the smallest node, roots left out.

    Alternating large-star and small-star contraction: O(log n) rounds of joins and partial
    aggregations, each round written to the shared folder. A node with very many edges is an
    ordinary skewed join key; nothing is gathered on the driver but two numbers per round.
    Nulls and self-edges are ignored.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = saved(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("lo"), hi.alias("hi")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(small, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
        after = saved(pairs.select(F.col("e.m").alias("lo"), F.col("e.hi").alias("hi")).where("lo != hi").distinct())
        dropped(now)
        now = after
