"""Best-fit packing of token sequences with swap-based local search, on counts of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismer.llm import bpe
from prismer.llm.common import modest, saved, tidy

#: A kind of bin: its lengths, descending.
Bin = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over counts of lengths: how many bins there are of each kind.

    Equal lengths are placed together, so the work follows the number of distinct lengths
    (capacity at most), not the number of pieces.
    """
    bins: Counter = Counter()
    room: dict[int, Counter] = {}
    free: list[int] = []

    def put(kind: Bin, n: int) -> None:
        left = capacity - sum(kind)
        if left <= 0:
            bins[kind] += n
            return
        if left not in room:
            room[left] = Counter()
            insort(free, left)
        room[left][kind] += n

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect_left(free, length)
            if i == len(free):
                each = min(capacity // length, todo)
                put((length,) * each, n := todo // each)
                todo -= n * each
                continue
            left = free[i]
            kind, have = next(iter(room[left].items()))
            n = min(have, todo)
            if n == have:
                del room[left][kind]
                if not room[left]:
                    del room[left], free[i]
            else:
                room[left][kind] -= n
            put((*kind, length), n)
            todo -= n
    for kinds in room.values():
        bins.update(kinds)
    return bins


def local_search(bins: Counter, capacity: int) -> Counter:
    """Move, swap one for one or two for one between underfull bins while the sum of squared fills grows.

    Each step takes from the emptiest kinds of bins and gives to fuller ones, for as many bins at a
    time as both kinds have; bins that lose all they hold go. It ends when the bins are as few as
    the total length allows or when no step between any two kinds helps.
    """
    bins = Counter(bins)
    total = sum(n * sum(k) for k, n in bins.items())
    least = -(-total // capacity)
    while sum(bins.values()) > least:
        slack = sorted((k for k in bins if sum(k) < capacity), key=lambda k: (sum(k), k))
        step = next(filter(None, (_better(a, b, bins, capacity) for a in slack for b in reversed(slack))), None)
        if step is None:
            break
        a, b, new_a, new_b, n = step
        for kind, change in ((a, -n), (b, -n), (new_a, n), (new_b, n)):
            bins[kind] += change
            if not bins[kind] or not kind:
                del bins[kind]
    return bins


def _better(a: Bin, b: Bin, bins: Counter, capacity: int) -> tuple | None:
    """A change that fills b more at the cost of a, the emptier: kinds before and after, and how many bins."""
    n = min(bins[a], bins[b]) if a != b else bins[a] // 2
    if not n or sum(a) > sum(b):
        return None
    left = capacity - sum(b)
    ones, gives = set(a), set(b) | {0}
    pairs = {(x, y) for x in ones for y in ones if x > y} | {(x, x) for x in ones if a.count(x) > 1}
    best = max(
        ((t - y, xs, y) for xs, t in [*(((x,), x) for x in ones), *(((x, y), x + y) for x, y in pairs)] for y in gives if 0 < t - y <= left and not (len(xs) == 2 and not y)),
        default=None,
    )
    if best is None:
        return None
    _, xs, y = best
    new_a, new_b = list(a), list(b)
    for x in xs:
        new_a.remove(x)
        new_b.append(x)
    if y:
        new_b.remove(y)
        new_a.append(y)
    return a, b, tuple(sorted(new_a, reverse=True)), tuple(sorted(new_b, reverse=True)), n


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length the places of its pieces, by rank: arrays of first rank, first sequence, pieces a bin, offset; and the number of sequences."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for kind, n in sorted(local_search(best_fit(counts, capacity), capacity).items()):
        at = 0
        for length, each in Counter(kind).items():
            slots.setdefault(length, []).append((used[length], base, each, at))
            used[length] += n * each
            at += length * each
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}, base


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document's ids and end_id, cut from the end into pieces of capacity ids (the first may be shorter).

    part and rank number the pieces of equal length: rank counts them within a task's part.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, flat, ends in bpe.encoder(tokenizer).slices(batch.column(1)):
                k = len(ends)
                values = np.insert(flat.astype("<u4"), ends, end_id)
                places = np.append(0, ends + np.arange(1, k + 1))
                n = np.diff(places)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(k), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                stop = n[doc] - (many[doc] - 1 - piece) * capacity
                start = np.maximum(stop - capacity, 0)
                length = stop - start
                order = np.argsort(length, kind="stable")
                runs = length[order]
                within = np.empty(len(doc), np.int64)
                within[order] = np.arange(len(doc)) - np.searchsorted(runs, runs)
                rank = seen[length] + within
                seen += np.bincount(length, minlength=capacity + 1)
                a = places[:-1][doc] + start
                raw = memoryview(values).cast("B")
                cols = [
                    batch.column(0).slice(rows.start, k).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist())], pa.int64()),
                    pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(rank),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, places[-1]), pa.int32()), pa.array(values.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), kind)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): all pieces of all documents in few sequences.

    A sequence holds at most capacity ids, without gaps. Null text is empty (one piece, the end id);
    null doc_ids stay null; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. Packing needs only the count of each length (capacity numbers at most, on
    the driver); the pieces are then dealt to places by their rank among those of equal length,
    which tasks count apart, so no length's pieces come together in one task.
    """
    modest(docs.sparkSession)
    rows = saved(pieces(docs, tokenizer, capacity, end_id, with_ids))
    counts = rows.groupBy("part", "length").count()
    sums = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    slots, _ = plan(sums, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    ranked = rows.join(shifts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length).tolist():
                first, base, each, at = slots[x]
                mine = np.flatnonzero(length == x)
                i = np.searchsorted(first, rank[mine], "right") - 1
                past = rank[mine] - first[i]
                sequence[mine], offset[mine] = base[i] + past // each[i], at[i] + past % each[i] * x
            cols = {n: batch.column(n) for n in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([cols[c.split()[0]] for c in kind.split(", ")], [c.split()[0] for c in kind.split(", ")])

    return ranked.select(*names, "rank").mapInArrow(deal, kind)
