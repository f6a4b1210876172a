"""Pairs of packed k-mers and colors as blocks of sorted differences, so that a shuffle moves few large rows.

A block holds the pairs of a part of a task whose scrambled k-mer begins with the same bits. A reducer puts
the blocks of one such range together, whatever their number: its memory is that of the range's distinct pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismer.functions.seq import CODES, packed

U = np.uint64
SCHEMA = "part int, color_bits int, width int, low binary, place binary, high binary, shift int"
#: Leading bits of a scrambled k-mer that name its part; pairs a task gathers, and pairs or k-mers it works on at once.
PART_BITS, GATHERED, AT_ONCE = 12, 4 << 20, 1 << 19
_ODD = 0x9E3779B97F4A7C15
Fold = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def scrambled(kmer: np.ndarray, k: int) -> np.ndarray:
    """A bijection of the numbers of 2 k bits that spreads k-mers evenly over the parts."""
    half, full = U(k), U((1 << 2 * k) - 1)
    x = kmer.astype(U)
    x ^= x >> half
    x *= U(_ODD)
    x &= full
    x ^= x >> half
    return x


def unscrambled(x: np.ndarray, k: int) -> np.ndarray:
    half, full = U(k), U((1 << 2 * k) - 1)
    x = x ^ (x >> half)
    x *= U(pow(_ODD, -1, 1 << 64))
    x &= full
    x ^= x >> half
    return x


def distinct(x: np.ndarray, color: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs by rising k-mer and color."""
    bits = int(color.max()).bit_length() if len(color) else 0
    if len(color) and int(color.min()) < 0:
        raise ValueError("colors must not be negative")
    if 2 * k + bits <= 64:
        both = (x << U(bits)) | color.astype(U) if bits else x.copy()
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        return both >> U(bits) if bits else both, (both & U((1 << bits) - 1)).astype(np.int32)
    order = np.lexsort((color, x))
    x, color = x[order], color[order]
    new = np.append(True, (x[1:] != x[:-1]) | (color[1:] != color[:-1]))
    return x[new], color[new].astype(np.int32)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encoded(x: np.ndarray, color: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Distinct pairs as rows of SCHEMA.

    Differences of a pair and the one before in its part take two bytes, with place and value of what exceeds
    them; eight where many do. Pairs beyond 64 bits stand as they are (color_bits -1).
    """
    if not len(x):
        return
    down = U(max(2 * k - PART_BITS, 0))
    part = x >> down
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends, part = np.append(at, len(x)), part[at]
    none = np.zeros(len(at) + 1, np.int64)
    bits = int(color.max()).bit_length()
    if 2 * k + bits > 64:
        width, low, place, high = 8, _binary(x, ends * 8), _binary(np.zeros(0, np.uint32), none), _binary(color.astype(np.int32), ends * 4)
        bits = -1
    else:
        both = (x << U(bits)) | color.astype(U)
        step = np.diff(both, prepend=U(0))
        step[at] = both[at] - ((part << down) << U(bits))
        over = np.flatnonzero(step >> U(16))
        if len(over) * 4 <= len(step):
            before = np.searchsorted(over, ends)
            own = over - np.repeat(at, np.diff(before))
            width, low, place, high = 2, _binary(step.astype(np.uint16), ends * 2), _binary(own.astype(np.uint32), before * 4), _binary(step[over] >> U(16), before * 8)
        else:
            width, low, place, high = 8, _binary(step, ends * 8), _binary(np.zeros(0, np.uint32), none), _binary(np.zeros(0, U), none)
    n, same = len(at), lambda v: pa.array(np.full(len(at), v, np.int32))
    rows = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), same(bits), same(width), low, place, high, same(0)], ["part", "color_bits", "width", "low", "place", "high", "shift"])
    for i in range(0, n, 1024):
        yield rows.slice(i, 1024)


def _values(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and the number of them in each row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(dtype).itemsize
    # a copy, as the buffer may not be aligned
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy() if data is not None else np.zeros(0, np.uint8)
    return raw.view(dtype), np.diff(offsets) // size


def decoded(rows: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (scrambled k-mer, color) of rows that agree in color_bits and width."""
    bits, width = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
    shift = rows.column(6).to_numpy()
    if bits < 0:
        x, n = _values(rows.column(3), U)
        return x, _values(rows.column(5), np.int32)[0] + np.repeat(shift, n)
    step, n = _values(rows.column(3), np.uint16 if width == 2 else U)
    step = step.astype(U)
    starts = np.cumsum(n) - n
    place, m = _values(rows.column(4), np.uint32)
    step[place + np.repeat(starts, m)] |= _values(rows.column(5), U)[0] << U(16) if width == 2 else U(0)
    both = np.cumsum(step, dtype=U)
    base = ((rows.column(0).to_numpy().astype(U) << U(max(2 * k - PART_BITS, 0))) << U(bits)) - (both[starts] - step[starts])
    both += np.repeat(base, n)
    return both >> U(bits), (both & U((1 << bits) - 1)).astype(np.int32) + np.repeat(shift, n)


def _cuts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs that agree in color_bits and width and hold about AT_ONCE pairs."""
    kind = rows.column(1).to_numpy() * 16 + rows.column(2).to_numpy()
    offsets = np.frombuffer(rows.column(3).buffers()[1], np.int32, len(kind) + 1, 4 * rows.column(3).offset).astype(np.int64)
    group = (offsets[:-1] - offsets[0]) // (rows.column(2).to_numpy().max() * AT_ONCE)
    at = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (group[1:] != group[:-1])))
    for a, b in zip(at, np.append(at[1:], len(kind))):
        yield rows.slice(a, b - a)


def gather(pairs: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """(scrambled k-mer, color) to rows of SCHEMA, each pair once for GATHERED pairs."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= GATHERED:
            x, color = distinct(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]), k)
            # many pairs met again: go on with those that are left
            held, n = [(x, color)], len(x)
            if n > GATHERED // 2:
                yield from encoded(x, color, k)
                held, n = [], 0
    if n:
        yield from encoded(*distinct(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]), k), k)


def pairs_of(k: int, codes: np.ndarray = CODES, wanted: np.ndarray | None = None):
    """Rows (color, sequence) to blocks of (k-mer, color), of the wanted k-mers (scrambled, rising) if they are given."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if wanted is not None:
            down = U(max(2 * k - 24, 0))
            maybe = np.zeros(1 << min(2 * k, 24), bool)
            maybe[wanted >> down] = True
        for batch in batches:
            color = batch.column(0).to_numpy()
            for row, kmer in packed(batch.column(1), k, codes=codes):
                x = scrambled(kmer, k)
                if wanted is not None:
                    at = np.flatnonzero(maybe[x >> down])
                    x, row = x[at], row[at]
                    own = wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x if len(wanted) else np.zeros(len(x), bool)
                    x, row = x[own], row[own]
                    if not len(x):
                        continue
                yield x, color[row]

    return lambda batches: gather(pairs(batches), k)


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks dealt by part, those of a part one after the other."""
    return blocks.repartition("part").sortWithinPartitions("part")


def folded(k: int, fold: Callable[[], tuple[Fold, Callable[[], Iterator[pa.RecordBatch]]]]):
    """Sorted blocks to what a fold gives: it takes k-mers, where each one's colors begin (and the end), and the colors; and is asked once more at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, end = fold()
        down = U(max(2 * k - PART_BITS, 0))
        x, color = np.zeros(0, U), np.zeros(0, np.int32)
        held, n = [], 0

        def ready(x: np.ndarray, color: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x))
            for a in range(0, len(at) - 1, AT_ONCE):
                own = at[a : a + AT_ONCE + 1]
                yield from take(unscrambled(x[own[:-1]], k), own - own[0], color[own[0] : own[-1]])

        for batch in batches:
            for rows in _cuts(batch) if batch.num_rows else ():
                held.append(decoded(rows, k))
                n += len(held[-1][0])
                if n < max(2 * AT_ONCE, len(x)):
                    continue
                x, color = distinct(np.concatenate([x, *[h[0] for h in held]]), np.concatenate([color, *[h[1] for h in held]]), k)
                held, n = [], 0
                cut = int(np.searchsorted(x, (x[-1] >> down) << down))
                if cut:
                    yield from ready(x[:cut], color[:cut])
                    x, color = x[cut:].copy(), color[cut:].copy()
        if n or len(x):
            yield from ready(*distinct(np.concatenate([x, *[h[0] for h in held]]), np.concatenate([color, *[h[1] for h in held]]), k))
        yield from end()

    return run


def each(take: Fold):
    """A fold that keeps nothing between its calls."""
    return lambda: (take, lambda: iter(()))
