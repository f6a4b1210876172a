"""Exact token counts of every prefix of a text, by dynamic programming over tokens that end there."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from prismer.llm import bpe
from prismer.llm.common import modest, tidy


def _word(t: bpe.Table, word: str) -> list[int]:
    """The number of tokens of word[:i] for i = 1..len(word), in the file's byte alphabet.

    A prefix's encoding ends with the one token that is its suffix and fits the last token of
    what stands before it; the count is one more than there.
    """
    counts, last = [0], [-1]
    vocab, fits, longest = t.vocab.get, t.fits, t.longest
    for i in range(1, len(word) + 1):
        for j in range(max(0, i - longest), i):
            token = vocab(word[j:i])
            if token is not None and fits(last[j], token):
                counts.append(counts[j] + 1)
                last.append(token)
                break
        else:
            raise ValueError(f"no encoding of {word!r}")
    return counts[1:]


#: Letters of the byte alphabet that continue a UTF-8 sequence.
INNER = {bpe.LETTERS[b] for b in range(0x80, 0xC0)}


def _steps(counts: list[int]) -> bytes:
    """Differences of counts as signed bytes."""
    return bytes([b - a & 255 for a, b in zip([0, *counts], counts) if -128 <= b - a < 128 or _far()])


def _far() -> bool:
    raise OverflowError("a prefix's count differs by more than 127 from the one before")


@lru_cache(maxsize=2)
def counter(path: str) -> bpe.Pieces:
    """For each text one signed byte per code point: by how much it changes the token count.

    A special string counts as one token once it is whole; its proper prefixes count as plain text.
    """
    t, split = bpe.table(path), bpe.library(path).pre_tokenizer.pre_tokenize_str

    @lru_cache(maxsize=150_000)
    def word(w: str) -> bytes:
        counts = _word(t, w)
        return _steps([c for c, after in zip(counts, [*w[1:], ""]) if after not in INNER])

    def unit(u: str) -> bytes:
        if "'" in u or u[:2].isspace() and len(u) > 1:  # a prefix may be split otherwise than the whole
            return _steps(prefixes(u))
        return b"".join([word(w) for w, _ in split(u)])

    def prefixes(u: str) -> list[int]:
        """The counts of u's prefixes. One that ends in a pre-token has the pre-tokens before it, but for two cases: a contraction is no pre-token before it is whole, and blanks that end a prefix are one pre-token."""
        out, earlier, before, last = [], 0, 0, ""
        for w, (a, b) in split(u):
            raw, here = u[a:b], (before + np.cumsum(np.frombuffer(word(w), np.int8), dtype=np.int64)).tolist()
            after = here[-1]
            if raw[0] == "'" and raw[1:].isalpha():
                here[:-1] = [before + sum(_word(t, x)[-1] for x, _ in split(raw[:j])) for j in range(1, len(raw))]
            elif last.isspace() and raw[0].isspace():
                here[0] = earlier + _word(t, bpe.mapped(last + raw[0]))[-1]
            out += here
            earlier, before, last = before, after, raw
        return out

    def odd(texts: list[str]) -> list[bytes]:
        return [b"".join([unit(u) for u in bpe.UNITS.findall(x)]) for x in texts]

    plain = bpe.Pieces(lambda ws: [word(bpe.mapped(w)) for w in ws], odd, {}, "i1")
    if not t.special:
        return plain

    class Whole(bpe.Pieces):
        def _singles(self, texts: list[str]) -> list[bytes]:
            usual = [x for x in texts if not self.cut.search(x)]
            done = iter(plain._singles(usual) if usual else [])
            return [self._single(x) if self.cut.search(x) else next(done) for x in texts]

        def _single(self, text: str) -> bytes:
            out, before = [], ""
            for x in self.cut.split(text):
                if x in t.special:
                    part = np.frombuffer(plain._single(before + x), np.int8)[len(before) :].astype(int)
                    part[-1] = 1 - part[:-1].sum()
                    out.append(_steps(np.cumsum(part).tolist()))
                else:
                    out.append(plain._single(x))
                    before = x
            return b"".join(out)

    return Whole(plain.words, odd, dict.fromkeys(t.special, b""), "i1", room=400_000)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_steps of every document.

    prefix_steps holds one signed byte per code point; its running sum at i is the exact token
    count of the first i code points (count_at, cut_at). A null text is empty; an empty one has no
    tokens; a null doc_id stays null; repeated rows each give a row; other columns are ignored.
    Each task holds one Arrow batch and a cache of bounded size; there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for rows, flat, ends in pieces.slices(texts):
                begins = np.concatenate([[0], ends[:-1]])
                total = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
                part = texts.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(rows.start, len(part)),
                        pc.cast(pc.binary_length(part), pa.int64()),
                        pa.array(total[ends] - total[begins], pa.int64()),
                        pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "prefix_steps"],
                )

    modest(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, prefix_steps binary")


def count_at(prefix_steps: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars code points."""
    return int(np.frombuffer(prefix_steps, np.int8)[:n_chars].sum(dtype=np.int64))


def cut_at(prefix_steps: bytes, budget: int) -> int:
    """The most code points whose prefix has at most budget tokens."""
    sums = np.cumsum(np.frombuffer(prefix_steps, np.int8), dtype=np.int64)
    fit = np.flatnonzero(sums <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0
