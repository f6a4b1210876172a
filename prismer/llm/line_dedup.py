"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismer.llm.common import blocks, components, distinct_pairs, dropped, let, mix, modest, parts, saved, unused

#: Edits up to which two lines are near; lines of fewer characters than SHORTEST have no near lines.
EDITS, SHORTEST = 2, 20
U = np.uint64
#: In a line's word of marks: the classes of character pairs, and the bit that says that a list's segment is the line's own.
CLASSES = 58
LOW, OWN = U((1 << CLASSES) - 1), U(1 << 63)


def spans(n: np.ndarray, edits: int) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """For lines of n characters: size, segment, whether it is the line's own, start, width, and whether it exists, of each substring that probes or stands in an index.

    Of two lines within the edits, some segment of the shorter stands unchanged in the longer, moved
    by no more than the edits before it and, with the lengths' difference, those after it allow.
    """
    for gap in range(edits + 1):
        size = n - gap
        base, over = size // (edits + 1), size % (edits + 1)
        for i in range(edits + 1):
            width = base + (i > edits - over)
            at = i * base + np.maximum(0, i - (edits + 1 - over))
            for move in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1):
                start = at + move
                yield gap, i, not gap and not move, start, width, (size >= 0) & (start >= 0) & (start + width <= n)


class Points:
    """The code points of several lines in one array, with sums by which any substring is hashed at once."""

    ODD, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, lines: list[str]):
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.begin = np.cumsum(self.n) - self.n
        self.points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.append(U(1), np.full(len(self.points), U(self.ODD))), dtype=U)
            self.back = np.cumprod(np.append(U(1), np.full(len(self.points), U(self.BACK))), dtype=U)
            self.sums = np.append(U(0), np.cumsum(mix(self.points + U(1)) * powers[:-1], dtype=U))

    def hashes(self, rows: np.ndarray, start: np.ndarray, width: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """64-bit hashes of substrings of the lines in rows, another for each salt."""
        a = self.begin[rows] + start
        with np.errstate(over="ignore"):
            return mix((self.sums[a + width] - self.sums[a]) * self.back[a] + mix(salt.astype(U)))

    def marks(self) -> np.ndarray:
        """A word for each line: which of 58 classes hold an odd number of its pairs of neighbouring characters (an edit changes four at most), and above these its length's magnitude."""
        x = self.points
        with np.errstate(over="ignore"):
            both = mix(x[1:] * U(self.ODD) + x[:-1] * U(0xC2B2AE3D27D4EB4F)) % U(CLASSES)
        bit = np.append(U(1) << both, U(0))
        bit[self.begin[1:] - 1] = 0
        out = np.zeros(len(self.n), U)
        some = self.n > 0
        if some.any():
            out[some] = np.bitwise_xor.reduceat(bit, self.begin[some])
        size = np.minimum(31, np.ceil(np.log2(np.maximum(1, self.n)))).astype(U)
        return out | size << U(CLASSES)


def _near(edits: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines of marks x and y in one list may be within the edits: one of them has the segment as its own, and their odd pairs differ little."""
    return ((x | y) & OWN != 0) & (np.bitwise_count((x ^ y) & LOW) <= 4 * edits)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most edits: Hyyro's bit-parallel rows along a diagonal band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    head = len(os.path.commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not b:
        return len(a) <= edits
    band = 2 * edits + 1
    full = (1 << band) - 1
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    # bit r of the band stands for row j - edits + r of column j; the middle bit is the main diagonal
    up, down, score = full & ~((1 << edits) - 1), 0, 0
    low = 1 << edits
    for j, c in enumerate(b):
        where, shift = place.get(c, 0), j - edits
        match = (where >> shift if shift >= 0 else where << -shift) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = (down | ~(zero | up)) & full, zero & up
        score += not zero & low
        if score > 2 * edits:
            return False
        moved = zero >> 1
        up, down = (minus | ~(moved | plus)) & full, moved & plus
    # from the main diagonal's end go down the last column to a's end
    for k in range(len(a) - len(b)):
        bit = 1 << (edits + k)
        score += bool(up & bit) - bool(down & bit)
    return score <= edits


def _parted(batches: Iterator[pa.RecordBatch], shortest: int, short: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """For parts of rows (doc_id, th, text) of a megabyte: the part, its lines that are long enough (with `short` the shorter ones too that are not blank), and the row and number of each."""
    for part in parts(batches, 1_000_000, 2):
        lists = pc.split_pattern(part.column(2), "\n")
        at, flat = lists.offsets.to_numpy(), lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(at))
        use = pc.greater_equal(pc.utf8_length(flat), shortest)
        if short:
            use = pc.or_(use, pc.greater(pc.binary_length(pc.utf8_trim_whitespace(flat)), 0))
        use = use.to_numpy(zero_copy_only=False)
        yield part, flat.filter(pa.array(use)), row[use], (np.arange(len(flat)) - at[row])[use]


def _ids(lines: list[str]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, lines), U, len(lines)) ^ U(1 << 63)).view(np.int64)


class _Fresh:
    """Lines not met lately, of bounded memory."""

    def __init__(self, most: int = 200_000):
        self.seen: set[int] = set()
        self.most = most

    def of(self, lines: pa.Array) -> tuple[list[str], np.ndarray]:
        distinct = pc.unique(lines).to_pylist()
        ids = _ids(distinct)
        new = [i for i, x in enumerate(ids.tolist()) if x not in self.seen]
        if len(self.seen) > self.most:
            self.seen.clear()
        self.seen.update(ids[new].tolist())
        return [distinct[i] for i in new], ids[new]


def _open_lists(edits: int, few: int, most: int, chars: int):
    """From rows (h, g, k) sorted by h and g: the pairs a, b of lists of up to `few` rows that may be near (kind 0), and the rows of longer lists in blocks (kind 1: h, block, a = g, b = k).

    A block has at most `most` rows and about `chars` characters. Of a list that goes on in the next
    batch no more than `few` rows are held, and how far its last block is filled.
    """

    def out(kind: int, h: np.ndarray, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(block, pa.int64()), pa.array(a), pa.array(b)], ["kind", "h", "block", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going, place, filled = np.zeros((3, 0), np.int64), None, 0, 0

        def short_lists(rows: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            g, k, first, second = rows[1], rows[2].view(U), [], []
            for d in range(1, few):
                j = np.arange(d, len(g))
                j = j[start[j] <= j - d]
                if not len(j):
                    break
                j = j[_near(edits, k[j - d], k[j])]
                first.append(g[j - d])
                second.append(g[j])
            if first:
                a, b = distinct_pairs(np.concatenate(first), np.concatenate(second))
                if len(a):
                    zero = np.zeros(len(a), np.int64)
                    yield out(0, zero, zero, a, b)

        def long_rows(rows: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal place, filled, going
            h, g, k = rows
            size = np.int64(1) << ((k.view(U) & ~OWN) >> U(CLASSES)).astype(np.int64)
            total = np.cumsum(size)
            more = start == 0 if going is not None and len(h) and h[0] == going else np.zeros(len(h), bool)
            at = np.arange(len(h)) - start + place * more
            full = total - total[start] + size[start] + filled * more
            yield out(1, h, np.maximum(at // most, full // chars), g, k)
            if len(h):
                going, place, filled = int(h[-1]), int(at[-1]) + 1, int(full[-1])

        def emit(rows: np.ndarray, ended: bool) -> Iterator[pa.RecordBatch]:
            """Everything but a last short list that may go on."""
            nonlocal held
            h = rows[0]
            start = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[: len(h)], np.arange(len(h)), 0))
            size = np.bincount(start, minlength=len(h))[start]
            long = size > few
            if going is not None:
                long |= h == going
            keep = len(h) if ended or not len(h) or long[-1] else int(start[-1])
            held = rows[:, keep:]
            rows, start, long = rows[:, :keep], start[:keep], long[:keep]
            for pick, some in ((~long, short_lists), (long, long_rows)):
                if pick.any():
                    moved = np.cumsum(pick) - 1
                    yield from some(rows[:, pick], moved[start[pick]])

        for batch in batches:
            yield from emit(np.concatenate([held, np.stack([column.to_numpy() for column in batch.columns])], 1), False)
        yield from emit(held, True)

    return run


def _settled(edits: int, between: bool):
    """From rows (h, x, y, side, g, k, c, line) of blocks together: links of a spanning forest of each (h, x, y).

    Lines of one block, or of different sides with `between`, are compared unless their classes c
    or the links found meanwhile have joined them; those likest to the others go first.
    """

    def of(side: np.ndarray, g: np.ndarray, k: np.ndarray, c: np.ndarray, line: list[str]) -> Iterator[tuple[int, int]]:
        bits = (k[:, None] >> np.arange(CLASSES, dtype=U)) & U(1)
        odd = np.abs(bits - (bits.mean(0) > 0.5)).sum(1)
        order = np.argsort(odd, kind="stable")
        _, c = np.unique(c, return_inverse=True)
        for place, i in enumerate(order.tolist()):
            j = order[place + 1 :]
            j = j[(c[j] != c[i]) & _near(edits, k[i], k[j])]
            if between:
                j = j[side[j] != side[i]]
            for o in j.tolist():
                if c[o] != c[i] and within(line[i], line[o], edits):
                    c[c == c[o]] = c[i]
                    yield g[i], g[o]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 3):
            side, g, k, c = (block.column(i).to_numpy() for i in range(3, 7))
            links = list(of(side, g, k.view(U), c, block.column(7).to_pylist()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return run


def _texts(docs: DataFrame, ids: DataFrame, shortest: int) -> DataFrame:
    """id and line of every id, each once."""
    bits = docs.sparkSession.sparkContext.broadcast(_plain_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for _, lines, _, _ in _parted(batches, shortest):
            new, i = fresh.of(lines)
            at = i & ((1 << 23) - 1)
            hit = (bits.value[at >> 6].view(U) >> (at & 63).astype(U)) & U(1) == 1
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(i[hit]), pa.array([new[x] for x in np.flatnonzero(hit).tolist()], pa.string())], ["id", "line"])

    return docs.mapInArrow(run, "id long, line string").join(ids, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs of line ids that are within the edits, by their texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    two = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def links(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, few: int = 16, most: int = 1024, chars: int = 8_000_000) -> DataFrame:
    """Classes (node, root) of the ids of near lines in rows (doc_id, th, text), roots left out.

    Lines that share a substring's hash are a list. Lists of up to `few` lines give their pairs,
    each verified once. Longer lists are cut into blocks of at most `most` lines; a block's lines
    come to one task with their texts and leave it as links of a forest. Then the blocks of a list
    meet two by two, if its lines are of several classes still. No list, block or pair is left out.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for _, lines, _, _ in _parted(batches, shortest):
            new, ids = fresh.of(lines)
            if not new:
                continue
            points = Points(new)
            marks = points.marks()
            for gap, i, own, start, width, there in spans(points.n, edits):
                rows = np.flatnonzero(there)
                h = points.hashes(rows, start[rows], width[rows], (points.n[rows] - gap) * (edits + 1) + i)
                k = marks[rows] | OWN if own else marks[rows]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[rows]), pa.array(k.view(np.int64))], ["h", "g", "k"])

    lists = docs.mapInArrow(listed, "h long, g long, k long").repartition("h").sortWithinPartitions("h", "g")
    found = saved(lists.mapInArrow(_open_lists(edits, few, most, chars), "kind int, h long, block long, a long, b long"))
    pairs = saved(found.where("kind = 0").select("a", "b").distinct())
    rows = found.where("kind = 1").selectExpr("h", "block", "a as g", "b as k")
    lines = saved(_texts(docs, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(rows.select("g")).distinct(), shortest))
    text = lines.withColumnRenamed("id", "g")

    def together(rows: DataFrame, between: bool) -> DataFrame:
        rows = rows.join(text, "g").select("h", "x", "y", "side", "g", "k", "c", "line")
        return rows.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(_settled(edits, between), "a long, b long")

    inside = together(rows.selectExpr("h", "block as x", "block as y", "block as side", "g", "k", "g as c"), False)
    known = saved(components(_verified(pairs, lines, edits).unionAll(inside)))
    several = rows.groupBy("h").agg(F.max("block").alias("last")).where("last > 0")
    if several.take(1):
        classed = rows.join(several, "h").join(known.select(F.col("node").alias("g"), "root"), "g", "left").selectExpr("h", "block", "last", "g", "k", "coalesce(root, g) as c")
        apart = classed.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("h")
        met = classed.join(apart, "h", "left_semi").withColumn("other", F.explode(F.expr("sequence(0L, last)"))).where("other != block")
        more = together(met.selectExpr("h", "least(block, other) as x", "greatest(block, other) as y", "block as side", "g", "k", "c"), True)
        joined = saved(components(known.selectExpr("node as a", "root as b").unionAll(more)))
        dropped(known)
        known = joined
    for done in (found, pairs, lines):
        dropped(done)
    return known


def _plain_bits(ids: DataFrame, log: int = 23) -> np.ndarray:
    """A bit for each of 2^log remainders of the ids: a filter of fixed size, whatever the number of ids."""
    at = F.col("id").bitwiseAND(F.lit((1 << log) - 1))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def dedup(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, short: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines, n_dropped.

    Lines are what stands between line feeds. Two lines of at least `shortest` characters are near
    when their edit distance, in code points, is at most `edits`; of each class of lines joined by
    nearness the occurrence of the smallest (doc_id, line number) stays. Shorter lines stay; with `short` those that are not blank
    are classes of their own, equal lines only, and lose their repeats like the others. A null
    text stays null (0 lines), an empty one has one empty line; null doc_ids count as the greatest;
    rows equal in doc_id and text are treated alike; all rows stay, other columns are kept, columns
    named n_lines and n_dropped are replaced.

    Each distinct line gives its segments' hashes and those of the substrings it probes with; lines
    that share a hash are candidates (links()), unless their odd pairs of characters tell that they
    are further apart. No list is cut, and equal lines, however many, are one line.
    """
    modest(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(key.alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("text is not null")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines, row, number in _parted(batches, shortest, short):
            names = lines.dictionary_encode()
            l = _ids(names.dictionary.to_pylist())[names.indices.to_numpy()] if len(lines) else np.zeros(0, np.int64)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(l), part.column(0).take(row), part.column(1).take(row), pa.array(number.astype(np.int32))], ["l", "doc_id", "th", "k"])

    where = saved(keyed.mapInArrow(occurrences, "l long, doc_id long, th long, k int"))
    known = links(keyed, edits, shortest)
    spot = F.struct("doc_id", "th", "k")
    named = where.groupBy("l").agg(F.min(spot).alias("own")).join(known.select(F.col("node").alias("l"), "root"), "l", "left").withColumn("c", F.coalesce("root", "l"))
    # a class's first occurrence; lines alone in their class and met once need no decision
    firsts = named.groupBy("c").agg(F.min("own").alias("first"))
    of_line = named.select("l", "c").join(firsts, "c").select("l", "first")
    gone = where.join(of_line, "l").where(F.struct(F.col("doc_id"), F.col("th"), F.col("k")) != F.col("first"))
    d, th, lost = unused(docs, "d", "th", "lost")
    by_doc = gone.groupBy(F.col("doc_id").alias(d), F.col("th").alias(th)).agg(F.collect_set("k").alias(lost))
    joined = docs.join(by_doc, (F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)) == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(th)), "left")
    lines = F.split("text", "\n", -1)
    # the numbers kept are a difference of sets, so the work on a text follows its lines
    put = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: F.get(x, i)), "\n")
    kept = F.when(F.col(lost).isNull(), F.col("text")).otherwise(let(lines, put))
    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else kept.alias("text") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )
