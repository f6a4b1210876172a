"""Byte-pair tables read from a tokenizer file, exact merging, and cached encoding of Arrow columns."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White_Space of Unicode, as the tokenizers' patterns mean \\s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
#: A space after a space of any kind, in the syntax of Arrow's regular expressions.
BLANKS = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: At most a space, then letters, then ASCII marks but the apostrophe: pre-tokens that need no library to split.
WORDS = " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*"
MARKS = r"[!-&(-/:-@\[-`{-~]*"
#: Such pieces, each with a letter or a mark, a line feed before all but the first, which may lack: it is a pre-token of its own.
LINES = "^(?:{0})?(?:\n(?:{0}))+$".format(f"{WORDS[:-1]}+{MARKS}| ?{MARKS[:-1]}+")


class Table:
    """Vocabulary and merges of a BPE tokenizer file, tokens as strings of the file's own alphabet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.end: str = model.get("end_of_word_suffix") or ""
        self.longest = max(map(len, self.vocab))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(self.names) + 1
        self.joined: dict[int, bool] = {}

    def symbols(self, word: str) -> list[str]:
        """The word's single characters, the last with the end-of-word mark if the file has one."""
        return [*word[:-1], word[-1] + self.end] if word else []

    def exact(self, parts: list[str]) -> list[str]:
        """Merging in rank order, leftmost first: the definition of the encoding."""
        rank, never = self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(p, never) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == never:
                break
            out, i, last = [], 0, len(parts) - 1
            while i <= last:
                if i < last and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def split(self, token: str) -> list[str]:
        """A token's single symbols."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            return self.symbols(token[: -len(self.end)])
        return [*token]

    def fits(self, left: int, right: int) -> bool:
        """Whether ids left, right are the encoding of their joined text (-1 on the left: whether right is its own)."""
        if left < 0:
            return bool(self.trees[3][right])
        key = left * self.size + right
        if (known := self.joined.get(key)) is None:
            if len(self.joined) > 1_000_000:
                self.joined.clear()
            known = self.joined[key] = self._apart(left, right)
        return known

    def _apart(self, x: int, y: int) -> bool:
        """compatible() for one pair."""
        born, left, right, merge, n = self.lists
        if not (self.trees[3][x] and self.trees[3][y]):
            return False
        never = until_x = until_y = 1 << 62
        while True:
            rank = merge.get(x * n + y, never)
            if rank < until_x and rank <= until_y and rank < never:
                return False
            if born[x] > born[y]:
                until_x, x = born[x], right[x]
            elif born[y] >= 0:
                until_y, y = born[y], left[y]
            else:
                return True

    @property
    def trees(self) -> tuple[np.ndarray, ...]:
        """For each id the rank of its last merge (-1: none) and its two parts; sorted merge keys and ranks; ids that are their own encoding."""
        if not hasattr(self, "_trees"):
            n = self.size
            born, left, right, own = np.full(n, -1, np.int64), np.arange(n), np.arange(n), np.zeros(n, bool)
            for (a, b), r in self.rank.items():
                i = self.vocab[a + b]
                if born[i] < 0:
                    born[i], left[i], right[i] = r, self.vocab[a], self.vocab[b]
            for s, i in self.vocab.items():
                own[i] = self.exact(self.split(s)) == [s]
            keys = np.array([self.vocab[a] * n + self.vocab[b] for a, b in self.rank], np.int64)
            order = np.argsort(keys)
            self.lists = born.tolist(), left.tolist(), right.tolist(), {self.vocab[a] * n + self.vocab[b]: r for (a, b), r in self.rank.items()}, n
            self._trees = born, left, right, own, keys[order], order.astype(np.int64)
        return self._trees

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of ids, whether each pair a, b stays apart when their joined text is encoded.

        Both tokens' merge trees are undone along the shared border, the later merge first. The
        pair breaks if at some moment a merge across the border has a lower rank than the merge
        that next takes up either neighbour (on the right an equal rank too: leftmost goes first).
        """
        born, left, right, own, keys, ranks = self.trees
        n, never = len(born), np.int64(2**62)
        ok = own[a] & own[b]
        at = np.flatnonzero(ok)
        x, y = a[at].astype(np.int64), b[at].astype(np.int64)
        until_x, until_y = np.full(len(at), never), np.full(len(at), never)
        while len(at):
            k = x * n + y
            j = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            rank = np.where(keys[j] == k, ranks[j], never)
            bad = (rank < until_x) & (rank <= until_y) & (rank < never)
            ok[at[bad]] = False
            go = ~bad & ((born[x] >= 0) | (born[y] >= 0))
            at, x, y, until_x, until_y = at[go], x[go], y[go], until_x[go], until_y[go]
            first = born[x] > born[y]
            until_x, until_y = np.where(first, born[x], until_x), np.where(first, until_y, born[y])
            x, y = np.where(first, right[x], x), np.where(first, y, left[y])
        return ok


@lru_cache(maxsize=4)
def table(path: str) -> Table:
    return Table(path)


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _letters()
CODES = np.array([ord(LETTERS[b]) for b in range(256)], "<u2")


def mapped(text: str) -> str:
    """A text's bytes in the byte-level alphabet."""
    return text.encode().decode("latin-1").translate(LETTERS)


def _strings(keys: pa.Array) -> list[str]:
    """Strings without the character 0 as a list; faster than to_pylist."""
    if not len(keys):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(keys)], pa.int64()), keys.cast(pa.large_string()))
    return pc.binary_join(whole, pa.scalar("\0", pa.large_string()))[0].as_py().split("\0")


MARK = np.array([chr(b).isascii() and re.match(MARKS, chr(b))[0] != "" for b in range(256)])


def _halves(pieces: pa.Array) -> pa.Array:
    """Each piece's word and marks (without a word: all and nothing), for pieces of WORDS and MARKS."""
    n, (_, offsets, chars) = len(pieces), pieces.buffers()
    places = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + n + 1] if n else np.zeros(1, np.int32)
    raw = np.frombuffer(chars, np.uint8)[: places[-1]] if chars else np.zeros(0, np.uint8)
    marks = np.concatenate([[0], np.cumsum(MARK[raw], dtype=np.int32)])
    cuts = places[1:] - np.diff(marks[places])
    width = cuts - places[:-1]
    first = np.append(raw, 0)[places[:-1]] == 32
    cuts = np.where(width <= first, places[1:], cuts)
    both = np.append(np.stack([places[:-1], cuts], 1).ravel(), places[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(2 * n, pa.py_buffer(both), chars)


#: A byte that no UTF-8 text holds.
END = 255


def _end(path: str) -> int | None:
    """The id of END if words joined by it are encoded each as if alone: it is a token, no merge takes it up, and the model knows nothing but merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = model.get("merges")
    if not merges or any(LETTERS[END] in "".join(m) for m in merges) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    return model["vocab"].get(LETTERS[END])


def _mapped_words(words: list[str]) -> str:
    """The words in the byte-level alphabet, END after each."""
    raw = np.frombuffer("\0".join([*words, ""]).encode(), np.uint8)
    return CODES[np.where(raw == 0, END, raw)].tobytes().decode("utf-16-le")


def _joined(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[at:at + size], one after the other; 65,536 runs at once, so that the indexes stay small."""
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], flat.dtype)
    for a in range(0, len(size), 1 << 16):
        b = min(a + (1 << 16), len(size))
        index = np.repeat(at[a:b] - ends[a:b], size[a:b])
        index += np.arange(ends[a], ends[b])
        np.take(flat, index, out=out[ends[a] : ends[b]], mode="clip")
    return out


def _woven(second: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a, where second is true of b, in that order; all of them and their sizes."""
    at, size = np.empty(len(second), np.int64), np.empty(len(second), np.int64)
    at[~second], size[~second] = np.cumsum(a_size) - a_size, a_size
    at[second], size[second] = len(a) + np.cumsum(b_size) - b_size, b_size
    return _joined(np.concatenate([a, b]), at, size), size


class Store:
    """Values of strings, one after the other in one array that doubles as it fills."""

    def __init__(self, dtype: np.dtype):
        self.rows: dict[str, int] = {}
        self.flat, self.ends, self.used = np.empty(1024, dtype), np.zeros(1024, np.int64), 0

    def find(self, keys: list[str]) -> np.ndarray:
        """The keys' numbers, -1 for those that are not there."""
        return np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))

    def runs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of these numbers begin and their sizes."""
        at = self.ends[rows]
        return at, self.ends[rows + 1] - at

    def add(self, keys: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n, used = len(self.rows), self.used + len(flat)
        if n + len(keys) >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * (n + len(keys)))
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.flat[self.used : used] = flat
        self.ends[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(size)
        self.used = used
        self.rows.update(zip(keys, range(n, n + len(keys))))


class Pieces:
    """Applies a function of text to the whole texts of an Arrow column, each distinct piece once.

    A text is cut before each space that follows a non-space: no pre-token crosses such a cut, so
    the pieces' values, joined, are the text's value. words gives the values of new pre-tokens,
    odd those of pieces beyond WORDS, MARKS and LINES, special those of special strings, which are
    cut out first. Values are bytes, items of dtype. Pre-tokens and odd pieces are cached in two
    generations of at most room entries each, an eighth of that for odd ones, which return less often.
    """

    def __init__(self, words: Callable[[list[str]], list[bytes]], odd: Callable[[list[str]], list[bytes]], special: dict[str, bytes], dtype: str, fold: bool = False, room: int = 150_000):
        self.words, self.odd, self.special, self.dtype, self.fold, self.room = words, odd, special, np.dtype(dtype), fold, room
        self.caches = {simple: [Store(self.dtype), Store(self.dtype)] for simple in (True, False)}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _known(self, simple: bool, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of distinct keys, one after the other, and their sizes, from the cache or made; what is used stays in the young generation."""
        young, old = self.caches[simple]
        rows = young.find(keys)
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            at, size = young.runs(rows)
            return _joined(young.flat, at, size), size
        names = [keys[i] for i in missing.tolist()]
        back = old.find(names)
        new = back < 0
        made = (self.words if simple else self.odd)([names[i] for i in np.flatnonzero(new).tolist()]) if new.any() else []
        fresh, lengths = np.frombuffer(b"".join(made), self.dtype), np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
        at, size = old.runs(back[~new])
        flat, size = _woven(new, _joined(old.flat, at, size), size, fresh, lengths)
        at, sizes = young.runs(rows[rows >= 0])
        out, sizes = _woven(rows < 0, _joined(young.flat, at, sizes), sizes, flat, size)
        if len(young.rows) + len(missing) > (self.room if simple else self.room // 8):
            self.caches[simple] = [Store(self.dtype), young]
            young = self.caches[simple][0]
        young.add(names, flat, size)
        return out, sizes

    def _values(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces, two indexes each into runs that joined are the piece's value; the runs' array, their places and sizes."""
        simple = pc.match_substring_regex(pieces, f"^{WORDS}{MARKS}$").to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~simple)
        apart = pieces.take(pa.array(others))
        several = pc.match_substring_regex(apart, LINES).to_numpy(zero_copy_only=False)
        lines = pc.split_pattern(apart.filter(pa.array(several)), "\n")
        both = _halves(pa.concat_arrays([pieces.filter(pa.array(simple)), lines.flatten()]))
        if self.fold:
            both = pc.utf8_lower(pc.utf8_trim(both, " "))
        both = both.dictionary_encode()
        parts = both.indices.to_numpy().reshape(-1, 2)
        flat, size = self._known(True, _strings(both.dictionary))
        index = np.empty((len(pieces), 2), np.int64)
        index[simple] = parts[: len(pieces) - len(others)]
        if not len(others):
            return index, flat, np.cumsum(size) - size, size
        feed, none = len(size), len(size) + 1
        flats, sizes = [flat, self.feed], [size, [len(self.feed), 0]]
        size = np.concatenate(sizes)
        inner = np.full((len(parts) - (len(pieces) - len(others)), 3), feed)
        inner[:, :2] = parts[len(pieces) - len(others) :]
        begins = lines.offsets.to_numpy()
        inner[begins[1:] - 1, 2] = none
        runs = inner.ravel()
        flats.append(_joined(np.concatenate(flats), (np.cumsum(size) - size)[runs], size[runs]))
        total = np.concatenate([[0], np.cumsum(size[runs])])
        sizes.append(np.diff(total[3 * begins]))
        odd = self._known(False, apart.filter(pa.array(~several)).to_pylist())
        flats.append(odd[0])
        sizes.append(odd[1])
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        index[others[several], 0] = none + 1 + np.arange(several.sum())
        index[others[~several], 0] = none + 1 + several.sum() + np.arange((~several).sum())
        index[others, 1] = none
        return index, flat, np.cumsum(size) - size, size

    @cached_property
    def feed(self) -> np.ndarray:
        """The value of a line feed between two pieces."""
        return np.frombuffer(self.odd(["\n"])[0], self.dtype)

    def _single(self, text: str) -> bytes:
        return self._singles([text])[0]

    def _singles(self, texts: list[str]) -> list[bytes]:
        """The values of texts by their units, for texts with special strings or several blanks in a row."""
        cut = [self.cut.split(x) if self.cut else [x] for x in texts]
        units = [[] if x in self.special else UNITS.findall(x) for xs in cut for x in xs]
        whole = pa.array([u for us in units for u in us], pa.string()).dictionary_encode()
        index, flat, at, size = self._values(whole.dictionary)
        index = index[whole.indices.to_numpy()].ravel()
        n = size[index]
        flat = _joined(flat, at[index], n).tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], 2 * np.cumsum(list(map(len, units)))]).astype(np.int64)] * self.dtype.itemsize
        spans = zip(ends.tolist(), ends[1:].tolist())
        return [b"".join([flat[a:b] + self.special.get(x, b"") for x, (a, b) in zip(xs, spans)]) for xs in cut]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for _, flat, ends in self.slices(pa.array(texts, pa.string())):
            out += [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return out

    def slices(self, column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For runs of rows of at most most bytes (one row at least): the rows, their values, where each row's values end."""
        column = pc.fill_null(column, "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
            yield slice(a, b), *self._slice(column.slice(a, b - a))
            a = b

    def _slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart = pc.match_substring_regex(column, BLANKS).to_numpy(zero_copy_only=False)
        for s in self.special:
            apart |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(apart)
        alone = {i: np.frombuffer(x, self.dtype) for i, x in zip(odd.tolist(), self._singles(column.take(pa.array(odd)).to_pylist()))} if len(odd) else {}
        plain = column.filter(pa.array(~apart))
        lists = pc.split_pattern(plain, " ")
        firsts = lists.offsets.to_numpy()[:-1]
        pieces = lists.flatten().dictionary_encode()
        index, others = pieces.indices.to_numpy().copy(), pieces.dictionary
        starts = others.take(pa.array(index[firsts])).dictionary_encode()
        index[firsts] = len(others) + starts.indices.to_numpy()
        parts, pool, at, size = self._values(pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), others, pa.scalar("")), starts.dictionary]))
        index = parts[index].ravel()
        n = size[index]
        ends, flat = np.cumsum(n), _joined(pool, at[index], n)
        ends = np.concatenate([[0], ends])[2 * lists.offsets.to_numpy()[1:]] if len(plain) else np.zeros(0, np.int64)
        if not len(odd):
            return flat, ends
        begin, k, out = np.concatenate([[0], ends]), 0, []
        for i in range(len(column)):
            if i in alone:
                out.append(alone[i])
            else:
                out.append(flat[begin[k] : begin[k + 1]])
                k += 1
        return np.concatenate(out), np.cumsum([len(x) for x in out])


@lru_cache(maxsize=4)
def encoder(path: str) -> Pieces:
    """Little-endian unsigned 32-bit ids as the tokenizers library gives them."""
    lib = library(path)
    special, tokenize, end = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}, lib.model.tokenize, _end(path)

    def words(new: list[str]) -> list[bytes]:
        if end is None:
            return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in map(mapped, new)]
        text, ids, a = _mapped_words(new), array("I"), 0
        while a < len(text):
            b = text.find(LETTERS[END], a + 300) + 1 or len(text)
            ids.extend([t.id for t in tokenize(text[a:b])])
            a = b
        ids = np.array(ids, "<u4")
        ends = np.flatnonzero(ids == end)
        kept, at = ids[ids != end].tobytes(), (4 * (ends - np.arange(len(ends)))).tolist()
        return [kept[a:b] for a, b in zip([0, *at], at)]

    def odd(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]

    return Pieces(words, odd, {s: np.array([i], "<u4").tobytes() for s, i in special.items()}, "<u4")
