"""Sequence functions: k-mers, reverse complements, canonical forms, minimizers."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = string.ascii_lowercase + string.ascii_uppercase
BASES = "".join("ACGT"[i % 26 % 4] for i in range(52))


def dna(text: Column) -> Column:
    """A sequence made of a text: letters by their place in the alphabet mod 4, full stops and line ends as N."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, LETTERS, BASES), r"[.\n]", "N"), "[^ACGTN]", "")


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def valid(kmer: Column) -> Column:
    return ~kmer.rlike("[^ACGT]")


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k, none for a shorter sequence.

    The sequence is computed once, as bytes: a substring of bytes is found by its place, one of a
    string by a walk from its start.
    """

    def of(b: Column) -> Column:
        n = F.octet_length(b)
        places = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(b, i, F.lit(k)).cast("string"))

    return F.get(F.transform(F.array(seq.cast("binary")), of), F.lit(0))


def minimizer(kmer: Column, k: int, m: int) -> Column:
    """The smallest substring of length m."""
    return F.array_min(F.array(*[F.substring(kmer, i, m) for i in range(1, k - m + 2)]))


#: Two bits a base; 4 marks what is no base.
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i
#: Bases that fit a BIGINT.
PACKED = 31


#: dna of bytes: letters by their place in the alphabet mod 4, full stops and line ends break a sequence, 5 marks what is left out.
TEXT_CODES = np.full(256, 5, np.uint8)
for _c, _b in zip(LETTERS, BASES):
    TEXT_CODES[ord(_c)] = "ACGT".index(_b)
TEXT_CODES[[ord("."), ord("\n")]] = 4


def _windows(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of k bases as a number and its reverse complement's, from windows of half the length."""
    kind = np.uint32 if k <= 15 else np.uint64
    f, b, size = code.astype(kind), (3 - (code & 3)).astype(kind), 1
    f &= kind(3)
    whole = None
    rest = k
    while rest:
        if rest & 1:
            if whole is None:
                whole = (f, b, size)
            else:
                wf, wb, ws = whole
                n = len(f) - ws
                whole = ((wf[:n] << kind(2 * size)) | f[ws:], wb[:n] | (b[ws:] << kind(2 * ws)), ws + size)
        rest >>= 1
        if rest:
            f, b = (f[:-size] << kind(2 * size)) | f[size:], b[:-size] | (b[size:] << kind(2 * size))
            size *= 2
    n = len(code) - k + 1
    return whole[0][:n], whole[1][:n]


def packed(seqs: pa.Array, k: int, most: int = 1 << 18, codes: np.ndarray = CODES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, k-mer) of every canonical k-mer of the sequences, in parts of `most` bytes; a k-mer is a number of two bits a base.

    codes: of each byte its base, 4 for what no k-mer holds, 5 for what is left out of the sequence.
    """
    offsets = np.frombuffer(seqs.buffers()[1], np.int32, len(seqs) + 1, 4 * seqs.offset).astype(np.int64)
    if seqs.buffers()[2] is None:
        return
    data = np.frombuffer(seqs.buffers()[2], np.uint8)
    before, before_row = np.zeros(0, np.uint8), np.zeros(0, np.int32)
    for a in range(int(offsets[0]), int(offsets[-1]), most):
        z = min(a + most, int(offsets[-1]))
        # rows that have bytes here
        low, high = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, z, "left"))
        row = np.repeat(np.arange(low, high, dtype=np.int32), np.diff(np.clip(offsets[low : high + 1], a, z)))
        code = codes[data[a:z]]
        keep = code < 5
        if not keep.all():
            code, row = code[keep], row[keep]
        code, row = np.append(before, code), np.append(before_row, row)
        before, before_row = code[max(len(code) - k + 1, 0) :], row[max(len(code) - k + 1, 0) :]
        n = len(code) - k + 1
        if n <= 0:
            continue
        bad = np.append(np.int32(0), np.cumsum(code == 4, dtype=np.int32))
        forward, back = _windows(code, k)
        use = (bad[k:] == bad[:n]) & (row[:n] == row[k - 1 :])
        yield row[:n][use], np.minimum(forward, back)[use]


def turned(kmers: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed k-mers."""
    x = kmers.astype(np.uint64)
    for mask, by in ((0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4)):
        x = ((x >> np.uint64(by)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(by))
    return ~x.byteswap() >> np.uint64(64 - 2 * k)


def unpacked(kmers: np.ndarray, k: int) -> pa.Array:
    """Packed k-mers as strings."""
    out = np.empty((len(kmers), k), np.uint8)
    letters = np.frombuffer(b"ACGT", np.uint8)
    kmers = kmers.astype(np.uint64)
    for j in range(k):
        out[:, k - 1 - j] = letters[((kmers >> np.uint64(2 * j)) & np.uint64(3)).astype(np.uint8)]
    return pa.Array.from_buffers(pa.string(), len(kmers), [None, pa.py_buffer(np.arange(len(kmers) + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(out)])


def positions(reads: DataFrame, k: int, key: str = "query_idx") -> DataFrame:
    """(key, pos, kmer) for every place of every read, from 0."""
    return reads.select(key, F.posexplode(kmers(F.upper("seq"), k)).alias("pos", "kmer"))
