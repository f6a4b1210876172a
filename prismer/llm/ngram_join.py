"""N-gram Jaccard join by grouped prefixes: near-duplicate classes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismer.llm.common import blocks, components, distinct_pairs, dropped, mix, modest, parts, saved

#: Shingles known to be frequent that travel to every task; the order of the others is their hashes'.
FREQUENT = 100_000
#: Neighbours in a list that are compared before components are known.
NEAR = 4
#: Words of 64 odd bits kept for each set in lists, and the least number of a sketch's classes.
WORDS, CLASSES = 1, 256
KS, MS = [f"k{i + 1}" for i in range(WORDS)], [f"m{i + 1}" for i in range(WORDS)]
U = np.uint64


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another; and where each text's begin (one more at the end).

    Words are runs of other than ASCII white space with A-Z lower-cased. A text of fewer words has
    one shingle of all its words, one without words none. Shingles are 64-bit hashes.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[some]
    codes = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes.dictionary.to_pylist()), U, len(codes.dictionary))
    h = hashes[codes.indices.to_numpy()[some]] if len(hashes) else np.zeros(0, U)
    n = np.bincount(row, minlength=len(lists))
    begin = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        out = np.zeros(len(h), U)
        for k in range(width):
            part = np.zeros(len(h), U)
            part[: max(0, len(h) - k)] = h[k:]
            out = mix(out + part + U(0x9E3779B97F4A7C15))
        full = (np.arange(len(h)) - begin[row]) <= n[row] - width
        keep_h, keep_row = out[full], row[full]
        short = np.flatnonzero((n > 0) & (n < width))
        more = np.zeros(len(short), U)
        for i, r in enumerate(short.tolist()):
            x = np.array([n[r]], U)
            for w in h[begin[r] : begin[r] + n[r]]:
                x = mix(x * U(3) + w)
            more[i] = x[0]
    all_h, all_row = np.concatenate([keep_h, more]), np.concatenate([keep_row, short])
    order = np.lexsort((all_h, all_row))
    all_h, all_row = all_h[order], all_row[order]
    new = np.ones(len(all_h), bool)
    new[1:] = (all_h[1:] != all_h[:-1]) | (all_row[1:] != all_row[:-1])
    all_h, all_row = all_h[new], all_row[new]
    return all_h, np.append(0, np.cumsum(np.bincount(all_row, minlength=len(lists))))


def _sums(h: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.append(U(0), np.cumsum(mix(h + U(salt)), dtype=U))
        return total[begin[1:]] - total[begin[:-1]]


def _odd(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """64 bits in each of WORDS words for each set: whether an odd number of its hashes fall in each of so many classes."""
    bit, second = U(1) << (h & U(63)), (h >> U(6)) % U(WORDS)
    total = [np.append(U(0), np.bitwise_xor.accumulate(bit * (second == w))) for w in range(WORDS)]
    return tuple(t[begin[1:]] ^ t[begin[:-1]] for t in total)


def sketches(h: np.ndarray, begin: np.ndarray) -> pa.Array:
    """For each set how many of its hashes fall in each of so many classes, one byte a class (255 stands for more).

    There are CLASSES classes, or from an eighth to a quarter of the set's size where that is more;
    the classes of a shorter sketch are sums of those of a longer one.
    """
    n = np.diff(begin)
    wide = np.where(n > 0, np.maximum(CLASSES, 1 << np.ceil(np.log2(np.maximum(1, n / 8))).astype(np.int64)), 0)
    ends = np.cumsum(wide)
    row = np.repeat(np.arange(len(n)), n)
    at = (h >> U(20)).astype(np.int64) & (wide[row] - 1)
    counts = np.minimum(np.bincount(at + (ends - wide)[row], minlength=int(ends[-1]) if len(n) else 0), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(counts)]).cast(pa.binary())


def folded(sketch: np.ndarray, wide: int) -> np.ndarray:
    """A sketch of fewer classes, the same that the set itself would give."""
    return sketch.astype(np.int64) if len(sketch) == wide else np.minimum(255, sketch.reshape(-1, wide).sum(0, dtype=np.int64))


def alike(x: bytes, y: bytes, n: int, percent: int) -> bool:
    """Whether two sets of n hashes together may link: classes that differ by d have d hashes at least that only one set has."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    wide = min(len(p), len(q))
    return (100 + percent) * int(np.abs(folded(p, wide) - folded(q, wide)).sum()) <= (100 - percent) * n


def _near_sets(percent: int):
    """Whether groups i and j may hold linked sets, from words KS (odd bits) and MS (bits all members agree on).

    The bits in which two sets differ are at most the shingles that only one of them has, and the similarity bounds these.
    """

    def near(n: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k, m = words[:WORDS].view(U), words[WORDS:].view(U)
        far = sum(np.bitwise_count((k[w][i] ^ k[w][j]) & m[w][i] & m[w][j]).astype(np.int64) for w in range(WORDS))
        return (100 + percent) * far <= (100 - percent) * (n[i] + n[j])

    return near


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def frequent(docs: DataFrame, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The hashes met most often twice or more in some task's share, with their counts; at most `most`, sorted by hash.

    It only sets the order in which shingles are looked at: a shingle in very many documents meets
    another in some share, is counted there, and comes late in every prefix. Any order gives
    the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            n = np.diff(np.append(at, len(x)))
            return pa.RecordBatch.from_arrays([_signed(x[at[n > 1]]), pa.array(n[n > 1])], ["h", "n"])

        for part in parts(batches):
            h, _ = shingle_sets(part.column(1), width)
            held.append(h)
            size += len(h)
            if size > 2_000_000:
                yield counted()
                size = 0
        if held:
            yield counted()

    top = docs.select("doc_id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = top["h"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, width: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n (set size), s1, s2 (the set's hash), p1, p2 (its prefix's hash), KS (its odd bits), prefix and sketch.

    The prefix holds the n - ceil(t n) + 1 rarest shingles; two sets with similarity t or more
    share one of them. Rows without shingles are kept with n = 0.
    """
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = known.value
        for part in parts(batches):
            h, begin = shingle_sets(part.column(1), width)
            n = np.diff(begin)
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1)) if len(hot) else np.zeros(len(h), int)
            weight = np.where(hot[at] == h, count[at], 0) if len(hot) else np.zeros(len(h), int)
            s1, s2 = _sums(h, begin, 1), _sums(h, begin, 2)
            odd, sketch = _odd(h, begin), sketches(h, begin)
            h = h[np.lexsort((h, weight, row))]
            size = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
            first = (np.arange(len(h)) - begin[row]) < size[row]
            h = h[first]
            starts = np.append(0, np.cumsum(size))
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((starts * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), _signed(s1), _signed(s2), _signed(_sums(h, starts, 3)), _signed(_sums(h, starts, 4)), *map(_signed, odd), raw.cast(pa.binary()), sketch],
                ["doc_id", "n", "s1", "s2", "p1", "p2", *KS, "prefix", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, " + " long, ".join(KS) + " long, prefix binary, sketch binary")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, prefix, KS, MS) to a row (h, g, n, at, KS, MS) for each shingle of the prefix, at being its place there."""
    for batch in batches:
        raw = batch.column(2)
        size = pc.binary_length(raw).to_numpy() // 8
        h = np.frombuffer(b"".join(raw.to_pylist()), np.int64)
        rows = np.repeat(np.arange(len(size)), size)
        places = np.arange(len(h)) - (np.cumsum(size) - size)[rows]
        for a in range(0, len(h), 500_000):
            row = pa.array(rows[a : a + 500_000])
            first = [pa.array(h[a : a + 500_000]), batch.column(0).take(row), batch.column(1).take(row), pa.array(places[a : a + 500_000])]
            yield pa.RecordBatch.from_arrays(first + [batch.column(i).take(row) for i in range(3, 3 + 2 * WORDS)], ["h", "g", "n", "at", *KS, *MS])


def _may(percent: int, n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j may link if the shingle they share here is the first they share: what can follow it is bounded by the places left."""
    most = np.minimum(n[i] - at[i], n[j] - at[j])
    return 100 * most >= percent * (n[i] + n[j] - most)


def _first_pairs(percent: int):
    """From rows (h, g, n, at, KS, MS) sorted by h, n and g: pairs a, b to compare at first (kind 0), and the h of lists that hold more (kind 1, in a).

    Each row is compared with the NEAR rows before it that have its h and a compatible size. Where
    there are more of these it is also compared with the list's first row here and with one
    half-way, which mostly joins a group of copies at once; such lists are looked at again once
    components are known. Pairs whose bits tell that they cannot link are left out. A linked pair passes the bound on places in the list of its first common
    shingle, so pairs that fail it in a list are left to the others. Only the last rows are held from batch to batch, however long a list is.
    """

    near = _near_sets(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((4 + 2 * WORDS, 0), np.int64)
        for batch in batches:
            old = tail.shape[1]
            rows = np.concatenate([tail, np.stack([batch.column(i).to_numpy() for i in range(4 + 2 * WORDS)])], 1)
            h, g, n, at, words = *rows[:4], rows[4:]
            k, a, b = len(h), [], []
            for d in range(1, NEAR + 1):
                j = np.arange(max(old, d), k)
                fit = (h[j - d] == h[j]) & _may(percent, n, at, j - d, j) & near(n, words, j - d, j)
                a.append(g[j[fit] - d])
                b.append(g[j[fit]])
            j = np.arange(max(old, NEAR + 1), k)
            j = j[(h[j - NEAR - 1] == h[j]) & (100 * n[j - NEAR - 1] >= percent * n[j])]
            start = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[:k], np.arange(k), 0)) if k else np.zeros(0, int)
            for i in (start[j], start[j] + (j - start[j]) // 2):
                fit = _may(percent, n, at, i, j) & near(n, words, i, j)
                a.append(g[i[fit]])
                b.append(g[j[fit]])
            both = distinct_pairs(np.concatenate(a), np.concatenate(b))
            hot = np.unique(h[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(both.shape[1], np.int32)), pa.array(both[0]), pa.array(both[1])], ["kind", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(hot), np.int32)), pa.array(hot), pa.array(hot)], ["kind", "a", "b"])
            tail = rows[:, max(0, k - NEAR - 1) :]

    return run


def _numbered(most: int):
    """From rows (h, ...) sorted by h: the rows with block, their place in their list over most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            at = np.arange(len(h))
            start = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), at, 0))
            place = at - start + seen * ((start == 0) & (h[0] == last))
            last, seen = h[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place // most)], [*batch.schema.names, "block"])

    return run


def _rest_pairs(percent: int):
    """From rows (h, x, y, block, g, n, at, c, bits, sketch) of blocks x and y together: all pairs of rows of a block, or of the two, that may link and are of different components c."""
    near = _near_sets(percent)

    def of(block: np.ndarray, g: np.ndarray, n: np.ndarray, at: np.ndarray, c: np.ndarray, words: np.ndarray, sketch: list[bytes]) -> Iterator[np.ndarray]:
        raw = [np.frombuffer(x, np.uint8) for x in sketch]
        least = np.stack([folded(x, CLASSES) for x in raw]).astype(np.int16)
        between = block.min() != block.max()
        for j in range(1, len(g)):
            i = np.flatnonzero((c[:j] != c[j]) & (100 * np.minimum(n[:j], n[j]) >= percent * np.maximum(n[:j], n[j])) & ((block[:j] != block[j]) if between else True))
            i = i[_may(percent, n, at, i, j)]
            i = i[near(n, words, i, np.full(len(i), j))]
            i = i[(100 + percent) * np.abs(least[i] - least[j]).sum(1, dtype=np.int64) <= (100 - percent) * (n[i] + n[j])]
            i = [o for o in i.tolist() if min(len(raw[o]), len(raw[j])) == CLASSES or alike(sketch[o], sketch[j], n[o] + n[j], percent)]
            if i:
                yield np.stack([np.minimum(g[i], g[j]), np.maximum(g[i], g[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            both = distinct_pairs(*np.concatenate(held, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for rows in blocks(batches, 3):
            x = np.stack([rows.column(i).to_numpy() for i in range(3, 8 + 2 * WORDS)])
            for found in of(*x[:5], x[5:], rows.column(8 + 2 * WORDS).to_pylist()):
                held.append(found)
                size += found.shape[1]
                if size > 200_000:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    return run


def _bits(ids: DataFrame, log: int = 23) -> np.ndarray:
    """A bit for each of 2^log remainders of the ids' hashes: a filter of fixed size, whatever the number of ids."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << log))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << log}) & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (log - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _maybe_met(lists: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of lists whose h may be one of ids (id), by the ids' bits; so the others, mostly all, are not shuffled to meet the ids."""
    bits = lists.sparkSession.sparkContext.broadcast(_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            place = batch.column(len(columns)).to_numpy()
            yield batch.select(range(len(columns))).filter(pa.array((words[place >> 6] >> (place & 63)) & 1 == 1))

    at = F.pmod(F.xxhash64("h"), F.lit(1 << 23)).alias("place")
    return lists.select(*columns, at).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def plausible(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sketches do not rule out a link: no linked pair is lost, and sets, which are far larger, move for the others only."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_pylist()
            keep = [alike(x.as_buffer(), y.as_buffer(), z, percent) for x, y, z in zip(batch.column(3), batch.column(4), n)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = base.where("n > 0")
    two = pairs.join(of.selectExpr("doc_id as a", "n as na", "sketch as x"), "a").join(of.selectExpr("doc_id as b", "n as nb", "sketch as y"), "b")
    return two.selectExpr("a", "b", "na + nb as n", "x", "y").mapInArrow(check, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose shingle sets reach the similarity, exactly; pairs is read several times."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = spark.sparkContext.broadcast(_bits(ids))
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 23))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            hit = (words[place >> 6] >> (place & 63)) & 1 == 1
            for part in parts(iter([batch.filter(pa.array(hit))])):
                h, begin = shingle_sets(part.column(1), width)
                raw = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((begin * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays([part.column(0), raw.cast(pa.binary())], ["id", "set"])

    found = near.select("doc_id", "text", at.alias("at")).mapInArrow(sets, "id long, set binary").join(ids, "id", "left_semi")
    found = saved(found)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = found.select(F.col("id").alias("a"), F.col("set").alias("x")), found.select(F.col("id").alias("b"), F.col("set").alias("y"))
    out = saved(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct())
    dropped(found)
    return out


def _expanded(met: DataFrame, entities: DataFrame, groups: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of entities, not joined by links yet, that may link, of the group pairs `met` in which a group has several entities."""
    several = groups.where("k > 1").select("g").distinct()
    one = met.join(several.select(F.col("g").alias("a"), F.lit(True).alias("of_a")), "a", "left").join(several.select(F.col("g").alias("b"), F.lit(True).alias("of_b")), "b", "left")
    who = entities.join(groups.select("n", "p1", "p2", "g"), ["n", "p1", "p2"]).join(known.select(F.col("node").alias("e"), "root"), "e", "left")
    who = who.select("g", "e", "n", *KS, F.coalesce("root", "e").alias("c"))
    x = one.where("of_a or of_b").select("a", "b").join(who, F.col("a") == F.col("g")).select("b", *[F.col(c).alias(f"x_{c}") for c in who.columns])
    y = who.select(*[F.col(c).alias(f"y_{c}") for c in who.columns])
    close = f"b = y_g and x_c != y_c and {100 + percent} * ({' + '.join(f'bit_count(x_{k} ^ y_{k})' for k in KS)}) <= {100 - percent} * (x_n + y_n)"
    return x.join(y, F.expr(close)).select(F.least("x_e", "y_e").alias("a"), F.greatest("x_e", "y_e").alias("b"))


def classes(docs: DataFrame, width: int = 5, percent: int = 80, most: int = 1024) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when their sets of word shingles have a Jaccard similarity of at least
    percent / 100; component_id is the smallest doc_id reachable by links. Sets are compared by
    64-bit hashes of shingles. Null, empty and wordless texts have 0 shingles and link with
    nothing. Equal sets link whatever their number. Rows of one doc_id are one node, each with its
    own n_shingles; a null doc_id has a null component. Extra columns are ignored.

    Documents of equal sets are one entity; entities of equal prefix and size are one group. Lists
    of the groups that share a prefix shingle give the group pairs; pairs whose 64 * WORDS odd bits differ too
    much to link are left out. They are first compared with a
    few neighbours in each list; then, in lists that hold more than those, all pairs are compared
    that are not yet joined by links; such a list is cut into blocks of `most` rows, two of which meet
    in a task. Pairs are held against the sets' sketches before any set is fetched. So no pair is left out, and copies of one text are not
    compared all with all. Rows meet by shingle, by doc_id or by pair; only the frequent shingles,
    of fixed number, and a bitmap of fixed size go to all tasks.
    """
    modest(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base = saved(prefixes(docs, width, percent, frequent(docs, width)))
    entities = saved(base.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("e"), *[F.min(c).alias(c) for c in ("p1", "p2", *KS)]))
    groups = entities.groupBy("n", "p1", "p2").agg(F.min("e").alias("g"), F.count("*").alias("k"), *[f(c).alias(f"{f.__name__[4:]}_{c}") for c in KS for f in (F.bit_and, F.bit_or)])
    groups = saved(groups.selectExpr("n", "p1", "p2", "g", "k", *[f"and_{k} as {k}" for k in KS], *[f"~(and_{k} ^ or_{k}) as {m}" for k, m in zip(KS, MS)]))
    bits = [*KS, *MS]
    leaders = base.drop("s2", "sketch", *KS).join(groups.drop("k").withColumnRenamed("g", "doc_id"), ["doc_id", "n", "p1", "p2"]).dropDuplicates(["doc_id", "s1"])
    lists = leaders.select(F.col("doc_id").alias("g"), "n", "prefix", *bits).mapInArrow(_spread, "h long, g long, n long, at long, " + ", ".join(f"{c} long" for c in bits))
    large = groups.where("k > 1").select("n", "p1", "p2")
    members = entities.join(large, ["n", "p1", "p2"]).selectExpr("xxhash64(p1, p2, n) as h", "e as g", "n", "0L as at", *KS, *[f"-1L as {m}" for m in MS])
    lists = saved(lists.unionByName(members))
    first = saved(lists.repartition("h").sortWithinPartitions("h", "n", "g").mapInArrow(_first_pairs(percent), "kind int, a long, b long").distinct())
    tried = first.where("kind = 0").select("a", "b")
    links = verified(docs, saved(plausible(tried, base, percent)), width, percent)
    known = saved(components(links))
    more = first.where("kind = 1").select(F.col("a").alias("h")).distinct()
    if more.take(1) or large.take(1):
        root = known.select(F.col("node").alias("g"), "root")
        # a group of several entities may have members elsewhere than its leader, so its pairs stay open
        apart = groups.where("k > 1").select("g", F.xxhash64("g").alias("own"))
        again = _maybe_met(lists, more.selectExpr("h as id"), ["h", "g", "n", "at", *bits]).join(more, "h", "left_semi").join(root, "g", "left").join(apart, "g", "left")
        again = saved(again.select("h", "g", "n", "at", F.coalesce("own", "root", "g").alias("c"), *bits))
        several = again.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("h")
        kinds = ", ".join(f"{c} long" for c in ("h", "g", "n", "at", "c", *bits, "block"))
        numbered = saved(again.join(several, "h", "left_semi").repartition("h").sortWithinPartitions("h", "n", "g").mapInArrow(_numbered(most), kinds))
        last = numbered.groupBy("h").agg(F.max("block").alias("last"))
        met = numbered.join(last, "h").withColumn("other", F.explode(F.expr("sequence(0L, last)")))
        met = met.selectExpr("h", "least(block, other) as x", "greatest(block, other) as y", "block", "g", "n", "at", "c", *bits)
        with_sketch = met.join(base.where("n > 0").selectExpr("doc_id as g", "sketch").dropDuplicates(["g"]), "g")
        rest = with_sketch.select("h", "x", "y", "block", "g", "n", "at", "c", *bits, "sketch").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
        rest = saved(rest.mapInArrow(_rest_pairs(percent), "a long, b long").distinct())
        todo = rest
        if large.take(1):
            todo = todo.unionByName(plausible(_expanded(tried.unionByName(rest), entities, groups, known, percent).distinct(), base, percent))
        todo = saved(todo.distinct().join(tried, ["a", "b"], "left_anti"))
        if todo.take(1):
            more_links = verified(docs, todo, width, percent)
            known = saved(components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more_links)))
        for done in (again, numbered, rest, todo):
            dropped(done)
    for done in (lists, first, groups):
        dropped(done)
    root = known.select(F.col("node").alias("e"), "root")
    by_set = entities.join(root, "e", "left").select("s1", "s2", "n", F.coalesce("root", "e").alias("c"))
    out = base.select("doc_id", "n", "s1", "s2").join(by_set, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents whose class has one of a smaller doc_id; rows with a null doc_id stay."""
    gone = classes(docs, width, percent).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
