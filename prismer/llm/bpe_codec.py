"""BPE encoding by proposal and check, and decoding, for word-level BPE files."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from prismer.llm import bpe


def _greedy(t: bpe.Table, word: str) -> list[int] | None:
    """Longest-match tokens of a word; None where nothing matches."""
    out, i, n, vocab, longest = [], 0, len(word), t.vocab, t.longest
    while i < n:
        for k in range(min(n, i + longest), i, -1):
            token = vocab.get(word[i:k] + t.end if k == n else word[i:k])
            if token is not None:
                out.append(token)
                i = k
                break
        else:
            return None
    return out


def encode_words(t: bpe.Table, words: list[str], stats: dict | None = None) -> list[list[int]]:
    """Ids of each word: greedy proposals, one vectorised check of all their adjacent pairs, exact merging of the rest."""
    tries = [_greedy(t, w) for w in words]
    flat = np.array([i for x in tries for i in x or ()], np.int64)
    sizes = np.array([len(x or ()) for x in tries], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    good = np.array([x is not None for x in tries], bool)
    if len(flat):
        own = t.trees[3]
        good[owner[~own[flat]]] = False
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique(np.stack([flat[:-1][inner], flat[1:][inner]]), axis=1, return_inverse=True)
        fit = t.compatible(pairs[0], pairs[1])
        good[owner[1:][inner][~fit[back.ravel()]]] = False
    if stats is not None:
        stats["words"] = stats.get("words", 0) + len(words)
        stats["exact"] = stats.get("exact", 0) + int((~good).sum())
    return [x if ok else [t.vocab[s] for s in t.exact(t.symbols(w))] for w, x, ok in zip(words, tries, good)]


@lru_cache(maxsize=2)
def encoder(path: str) -> bpe.Pieces:
    t, lib = bpe.table(path), bpe.library(path)
    normal = lib.normalizer.normalize_str if lib.normalizer else str
    split = lib.pre_tokenizer.pre_tokenize_str

    def encoded(new: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in encode_words(t, new)]

    def words(new: list[str]) -> list[bytes]:
        return encoded([bpe.mapped(w) for w in new])

    def odd(texts: list[str]) -> list[bytes]:
        parts = [[w for w, _ in split(normal(x))] for x in texts]
        new = list({w for ws in parts for w in ws})
        known = dict(zip(new, encoded(new)))
        return [b"".join([known[w] for w in ws]) for ws in parts]

    return bpe.Pieces(words, odd, {s: np.array([i], "<u4").tobytes() for s, i in t.special.items()}, "<u4", fold=True)


def decode(ids: bytes, path: str) -> str:
    """The text of ids as the library gives it for a file that names no decoder: tokens joined by spaces, special ones kept."""
    names = bpe.table(path).names
    return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (unless with_ids is false), decoded and the digests of both, for every document.

    Null text is empty: no ids, digests of nothing. Null ids stay null; repeated rows each give a
    row; other columns are ignored. No shuffle; a task holds one Arrow batch and a bounded cache.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = bpe.table(path).names
        strings = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        for batch in batches:
            for rows, flat, ends in encoder(path).slices(batch.column(1)):
                places = pa.array(np.append(0, ends), pa.int64())
                texts = pc.binary_join(pa.LargeListArray.from_arrays(places, strings.take(pa.array(flat.view("<i4")))), pa.scalar(" ", pa.large_string()))
                raw = memoryview(np.ascontiguousarray(flat)).cast("B")
                begins = np.append(0, ends[:-1])
                at = texts.buffers()
                offsets, chars = np.frombuffer(at[1], np.int64)[: len(texts) + 1].tolist(), memoryview(at[2] or b"")
                cols = [
                    batch.column(0).slice(rows.start, len(ends)),
                    pa.array(ends - begins, pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(begins.tolist(), ends.tolist())], pa.string()),
                    pa.array([hashlib.sha256(chars[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string()),
                ]
                if with_ids:
                    cols += [pa.ListArray.from_arrays(places.cast(pa.int32()), pa.array(flat.view("<i4"))), texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in kind.split(", ")])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, kind)
