"""Minimizer statistics, checksums, voting rules and mixture fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismer.functions.seq import CODES, PACKED, minimizer, turned, unpacked
from prismer.operators.index import Index, Tally
from prismer.plans.storage import stored

#: Bits of a tally's keys.
WIDE = 62


def class_stats(classes: DataFrame) -> DataFrame:
    """From (key, colors), a row a k-mer: by length of the key len, frac, correct, total, mean_class_size, mean_jaccard, n.

    A k-mer is correct if its set is the union of its class. The similarity is that of its set and the union.
    """
    # a row for the set's size, and one for each color
    parts = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("color"), F.size("colors").alias("size"))), F.transform("colors", lambda c: F.struct(c.cast("int").alias("color"), F.lit(None).cast("int").alias("size"))))
    each = classes.select("key", F.explode(parts).alias("p")).groupBy("key", "p.color", "p.size").agg(F.count("*").alias("n"))
    return _class_stats(each)


def _class_stats(each: DataFrame) -> DataFrame:
    """class_stats from (key, color, size, n): for each key how many sets have a size (color null), and its colors (size null).

    A set of the size of its class's union is the union; so neither sets nor unions are needed, but their sizes.
    """
    sizes = F.collect_list(F.when(F.col("color").isNull(), F.struct("size", "n")))
    union = F.count_if(F.col("color").isNotNull())
    total = lambda f: F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + f(x))
    keys = each.groupBy("key").agg(sizes.alias("_s"), union.alias("_u"))
    keys = keys.select(
        "key", total(lambda x: x["n"]).alias("size"), total(lambda x: F.when(x["size"] == F.col("_u"), x["n"]).otherwise(0)).alias("correct"),
        (total(lambda x: x["n"] * x["size"]) / F.col("_u") / total(lambda x: x["n"])).alias("jaccard"),
    )
    return keys.groupBy(F.length("key").alias("len")).agg(
        (F.sum("correct") / F.sum("size")).alias("frac"), F.sum("correct").alias("correct"), F.sum("size").alias("total"),
        F.avg("size").alias("mean_class_size"), F.avg("jaccard").alias("mean_jaccard"), F.count("*").alias("n"),
    )


def minimizer_stats(index: Index, m: int) -> DataFrame:
    """class_stats of k-mers by their smallest substring of length m."""
    if index.k > PACKED:
        return class_stats(index.both_strands().select(minimizer(F.col("kmer"), index.k, m).alias("key"), "colors"))
    each = index.fold(_minimizers(index.k, m), "key string, color int, size int, n long")
    return _class_stats(each.groupBy("key", "color", "size").agg(F.sum("n").alias("n")))


def _minimizers(k: int, m: int):
    """(key, color, size, n) for the minimizers of both strands: k-mers by set size and by color, summed in the task."""
    u = np.uint64

    def fold():
        tallies = Tally(1 << 20), Tally(1 << 20)  # by key and size, by key and color

        def least(kmer: np.ndarray) -> np.ndarray:
            out = kmer & u((1 << 2 * m) - 1)
            for i in range(1, k - m + 1):
                out = np.minimum(out, (kmer >> u(2 * i)) & u((1 << 2 * m) - 1))
            return out

        def put(which: int, key: np.ndarray, value: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            if 2 * m + int(value.max()).bit_length() > WIDE:
                yield rows(which, key, value, n)
                return
            tallies[which].add((value.astype(np.int64) << 2 * m) | key.astype(np.int64), n)
            if tallies[which].full:
                yield from emptied(which)

        def rows(which: int, key: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            own, none = pa.array(value.astype(np.int32)), pa.nulls(len(key), pa.int32())
            return pa.RecordBatch.from_arrays([unpacked(key, m), *((none, own) if which == 0 else (own, none)), pa.array(n)], ["key", "color", "size", "n"])

        def emptied(which: int) -> Iterator[pa.RecordBatch]:
            for both, n in tallies[which].taken():
                yield rows(which, (both & ((1 << 2 * m) - 1)).astype(u), both >> 2 * m, n)

        def take(kmer: np.ndarray, at: np.ndarray, color: np.ndarray) -> Iterator[pa.RecordBatch]:
            kmer, size = kmer.astype(u), np.diff(at)
            other = turned(kmer, k)
            ways = [least(kmer), least(other)]
            single = other == kmer  # its own reverse complement counts once
            for key, n in zip(ways, (np.ones(len(kmer), np.int64), (~single).astype(np.int64))):
                own = n > 0
                if own.any():
                    yield from put(0, key[own], size[own], n[own])
                    yield from put(1, np.repeat(key, size), color, np.repeat(n, size))

        def end() -> Iterator[pa.RecordBatch]:
            yield from emptied(0)
            yield from emptied(1)

        return take, end

    return fold


def _ends(k: int):
    """Rows (kmer) to (kmer, s): the substrings that end each k-mer, as numbers of their length and, last base first, their bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 15):
                kmer = _numbers(batch.column(0).slice(a, 1 << 15), k)
                back = _reversed(kmer, k)
                for i in range(1, k + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(_long(back >> np.uint64(2 * (k - i)), i))], ["kmer", "s"])

    return run


def _inner(k: int, least: int):
    """Rows (kmer, s) to (kmer, s) of all substrings of a k-mer, as _ends gives them, from the size `least` up to that of its own s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 15):
                kmer, most = (c.to_numpy() for c in batch.slice(a, 1 << 15).columns)
                back = _reversed(kmer, k)
                for i in range(least, k + 1):
                    own = (most >> 2 * i) > 0
                    if not own.any():
                        break
                    for j in range(k - i + 1):
                        yield pa.RecordBatch.from_arrays([pa.array(kmer[own]), pa.array(_long((back[own] >> np.uint64(2 * j)) & np.uint64((1 << 2 * i) - 1), i))], ["kmer", "s"])

    return run


def _numbers(kmers: pa.Array, k: int) -> np.ndarray:
    """K-mers of either strand as numbers."""
    offsets = np.frombuffer(kmers.buffers()[1], np.int32, len(kmers) + 1, 4 * kmers.offset)
    code = CODES[np.frombuffer(kmers.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, k)].astype(np.int64)
    out = np.zeros(len(kmers), np.int64)
    for j in range(k):
        out = out << 2 | code[:, j]
    return out


def _reversed(kmer: np.ndarray, k: int) -> np.ndarray:
    """The bases of packed k-mers from the last to the first: the complement of the reverse complement."""
    return ~turned(kmer, k) & np.uint64((1 << 2 * k) - 1)


def _long(bases: np.ndarray, size: int) -> np.ndarray:
    """Bases after a leading 1, so that shorter strings are smaller numbers."""
    return (bases | np.uint64(1 << 2 * size)).astype(np.int64)


def _strings(k: int):
    """Rows (kmer, s) to (kmer, key) with both as strings; s is as of _ends, of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(1).to_numpy()
            for size in range(1, k + 1):
                own = np.flatnonzero((s >> 2 * size) == 1)
                if len(own):
                    bases = _reversed(s[own] & ((1 << 2 * size) - 1), size)
                    yield pa.RecordBatch.from_arrays([unpacked(batch.column(0).to_numpy()[own], k), unpacked(bases, size)], ["kmer", "key"])

    return run


def finimizer_stats(index: Index) -> DataFrame:
    """class_stats of k-mers by the shortest substring that ends exactly one k-mer's prefix of that end; of several the least by reversed order.

    Substrings are counted as ends of k-mers of the index, k-mers alone (no padded ones). They travel as
    numbers; of the ends of a k-mer that no other has the shortest is kept, as a longer one is never chosen.
    """
    k, nodes = index.k, index.both_strands()
    if k > PACKED:
        return _finimizers_of_strings(nodes, k)
    ends = nodes.select("kmer").mapInArrow(_ends(k), "kmer long, s long")
    unique = stored(ends.groupBy("s").agg(F.count("*").alias("n"), F.min("kmer").alias("kmer")).where("n = 1").groupBy("kmer").agg(F.min("s").alias("s")))
    shortest = unique.agg(F.min("s")).first()[0]
    # a k-mer's own end is such a substring, so none longer is chosen
    inner = unique.mapInArrow(_inner(k, (shortest.bit_length() - 1) // 2 if shortest else k), "kmer long, s long")
    # never sent whole to each executor: it grows with the index
    inner = inner.join(unique.select("s").hint("shuffle_merge"), "s")
    best = inner.groupBy("kmer").agg(F.min("s").alias("s"))
    named = best.mapInArrow(_strings(k), "kmer string, key string")
    return class_stats(named.hint("shuffle_merge").join(nodes, "kmer").select("key", "colors"))


def _finimizers_of_strings(nodes: DataFrame, k: int) -> DataFrame:
    """finimizer_stats for any k."""
    ends = nodes.select(F.explode(F.array(*[F.substring("kmer", -i, i) for i in range(1, k + 1)])).alias("s"))
    unique = ends.groupBy("s").count().where("count = 1").select("s")
    inner = nodes.select("kmer", "colors", F.explode(F.array_distinct(F.array(*[F.substring("kmer", e - i + 1, i) for e in range(1, k + 1) for i in range(1, e + 1)]))).alias("s"))
    best = inner.join(unique.hint("shuffle_merge"), "s").groupBy("kmer", "colors").agg(F.min(F.struct(F.length("s").alias("l"), F.reverse("s").alias("r"))).alias("b"))
    return class_stats(best.select(F.reverse("b.r").alias("key"), "colors"))


def checksum(rows: DataFrame, value: Column) -> DataFrame:
    """(n, c0, c1, c2): number of rows and the exclusive or of the values' SHA-1, whatever their order, in parts of 60, 60 and 40 bits."""
    part = lambda i: F.conv(F.substring(F.sha1(value.cast("binary")), 1 + 15 * i, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), *[F.bit_xor(part(i)).alias(f"c{i}") for i in range(3)])


def vote(counts: DataFrame, least_unique: int, least_shared: int, fraction: float, key: str = "query_idx") -> DataFrame:
    """(key, color) with enough support: unique support if any color has enough of it, else shared support.

    counts: (key, color, uniq, shared). Enough is the greater of the support's least and floor(fraction * the read's most).
    """
    w = Window.partitionBy(key)
    need = lambda c, least: F.greatest(F.lit(least), F.floor(F.max(c).over(w) * fraction))
    rows = counts.withColumn("_u", F.col("uniq") >= need("uniq", least_unique)).withColumn("_s", F.col("shared") >= need("shared", least_shared))
    return rows.withColumn("_any", F.max(F.col("_u").cast("int")).over(w) == 1).where(F.when(F.col("_any"), F.col("_u")).otherwise(F.col("_s"))).select(key, "color")


def weighted_support(counts: DataFrame, weight: float, threshold: float, key: str = "query_idx", least_unique: int = 0, least_shared: int = 0) -> DataFrame:
    """(key, color) whose weighted share of unique and shared support reaches the threshold, up to 1e-8; counts as in vote, with den.

    Colors with less than the least of either support are out, and so is a read whose den is not above 0.
    """
    enough = (F.col("uniq") >= least_unique) & (F.col("shared") >= least_shared)
    share = (F.col("uniq") * weight + F.col("shared") * (1 - weight)) / F.when(F.col("den") > 0, F.col("den"))
    return counts.where(enough & (share >= threshold - 1e-8)).select(key, "color")


def consensus_counts(segments: DataFrame, key: str = "query_idx") -> DataFrame:
    """(key, color, uniq, shared): segments of a read with the color, and those that have no other."""
    each = segments.select(key, F.explode("colors").alias("color"), F.size("colors").alias("_n"))
    return each.groupBy(key, "color").agg(F.count_if(F.col("_n") == 1).alias("uniq"), F.count("*").alias("shared"))


def em(classes: DataFrame, rounds: int = 100, tolerance: float = 1e-5, ratio: float | None = None) -> dict[int, float]:
    """Mixture weights of colors from (colors, n): sets of compatible colors and how many reads have them.

    Each round shares a set's reads by the weights of its colors; with ratio a color outside the set
    counts 1 / ratio as much as one inside, without it reads of no color are left out. It stops when
    weights change by less than tolerance. A round is one aggregation; the driver keeps a number for each color.
    """
    return _fit(classes, rounds, tolerance, ratio, False)[0]


def em_with_ratio(classes: DataFrame, ratio: float, rounds: int = 100, tolerance: float = 1e-5) -> tuple[dict[int, float], float | None]:
    """Weights as of em, and the ratio, estimated anew each round from the weights before it.

    It is the expected number of reads whose color is in their set over that of the others; None
    once no read is expected outside its set, from where on colors outside count nothing.
    """
    return _fit(classes, rounds, tolerance, ratio, True)


def _fit(classes: DataFrame, rounds: int, tolerance: float, ratio: float | None, refit: bool) -> tuple[dict[int, float], float | None]:
    if ratio is not None and ratio <= 0:
        raise ValueError("the ratio must be above 0")
    rows = classes.where(F.size("colors") >= (1 if ratio is None else 0)).select("colors", F.col("n").cast("double").alias("n")).persist()
    names = [r[0] for r in rows.select(F.explode("colors").alias("c")).distinct().orderBy("c").collect()]
    total = rows.agg(F.sum("n")).first()[0]
    theta = dict.fromkeys(names, 1 / len(names)) if names else {}
    for _ in range(rounds if names else 0):
        outside = 0.0 if ratio is None else 1 / ratio
        weights = F.create_map(*[F.lit(x) for c, t in theta.items() for x in (c, t)])
        inside = F.aggregate(F.transform("colors", lambda c: F.element_at(weights, c)), F.lit(0.0), lambda a, x: a + x)
        whole = rows.withColumn("_in", inside).withColumn("_x", F.col("n") / F.nullif(F.col("_in") + F.lit(outside) * (1 - F.col("_in")), F.lit(0.0)))
        got = whole.select(F.explode("colors").alias("c"), "_x").groupBy("c").agg(F.sum("_x").alias("x"))
        shares = {r.c: r.x or 0.0 for r in got.collect()}
        base, hit = whole.agg(F.sum("_x"), F.sum(F.col("_x") * F.col("_in"))).first() if outside else (0.0, total)
        new = {c: t * (shares.get(c, 0.0) * (1 - outside) + outside * base) / total for c, t in theta.items()}
        after = ratio
        if refit and outside:
            after = hit / (total - hit) if total - hit > 1e-12 * total else None
        moved = 0.0 if after == ratio else math.inf if after is None else after - ratio
        change = math.sqrt(moved**2 + sum((new[c] - theta[c]) ** 2 for c in names))
        theta, ratio = new, after
        if change < tolerance:
            break
    rows.unpersist()
    return theta, ratio


def log_beta_binomial(n: int, k: int, a: float, b: float) -> float:
    """Logarithm of the beta-binomial probability."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + math.lgamma(k + a) + math.lgamma(n - k + b) - math.lgamma(n + a + b) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)


def log_posterior(classes: DataFrame, theta: dict[int, float]) -> float:
    """Sum over reads of the logarithm of their compatible colors' weight; classes as in em."""
    weights = F.create_map(*[F.lit(x) for c, t in theta.items() for x in (c, t)])
    inside = F.aggregate(F.transform("colors", lambda c: F.element_at(weights, c)), F.lit(0.0), lambda a, x: a + x)
    return classes.where(F.size("colors") > 0).agg(F.sum(F.col("n") * F.log(inside))).first()[0]


#: Fixed values of the clusters' likelihood: of a read without a hit, with any, and the beta-binomial's pi.
NO_HIT, SOME_HIT, PI = 0.01, 0.99, 0.65


def cluster_likelihoods(hits: DataFrame, clusters: DataFrame, key: str = "query_idx") -> DataFrame:
    """(key, cluster, likelihood) of reads and the clusters of colors they hit.

    hits: (key, cluster, hits), how many of the cluster's colors a read aligns to; clusters: (cluster, size).
    The matrix is sparse: a pair without a row, or with 0 hits, has NO_HIT. More hits than colors are an error.
    A beta-binomial probability is taken relative to that of a hit for every color.
    """
    n, k = F.col("size"), F.col("hits")
    phi = 1 - PI + NO_HIT / n
    alpha, beta = PI / phi, (1 - PI) / phi
    # from all n hits down to k, one factor a missing hit
    step = lambda a, i: a + F.log((k + i) / i) + F.log(i - 1 + F.col("_b")) - F.log(k + i - 1 + F.col("_a"))
    ln = F.when(n == k, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), n - k), F.lit(0.0), step))
    pairs = hits.join(clusters, "cluster").withColumn("hits", k.cast("long")).withColumn("size", n.cast("long"))
    kinds = pairs.select("hits", "size").distinct().withColumn("_a", alpha).withColumn("_b", beta)
    value = F.when(k == 0, F.lit(NO_HIT)).when((k == 1) & (n == 1), F.lit(SOME_HIT)).when((k < 0) | (k > n), F.raise_error(F.lit("more hits than the cluster has colors")).cast("double")).otherwise(SOME_HIT * F.exp(ln))
    return pairs.join(kinds.select("hits", "size", value.alias("likelihood")), ["hits", "size"]).select(key, "cluster", "likelihood")
