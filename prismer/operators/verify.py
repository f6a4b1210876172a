"""Checks of exported files: links of a GFA file, two dumps of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.functions.seq import revcomp
from prismer.operators import graph, research
from prismer.sources import formats


def wrong_links(lines: DataFrame, k: int) -> DataFrame:
    """(problem, a, a_strand, b, b_strand): links that GFA lines (value) lack and links that they should not have.

    Every pair of oriented segments that share k-1 bases must be there from both of its sides. A malformed
    line, a segment shorter than k, one given twice or an overlap other than k-1 is an error.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.select(f.alias("f"), "value")
    name, sign = "^u[0-9]+$", "^[+-]$"
    good_s = (F.size(f) >= 3) & at(1).rlike(name) & (F.length(at(2)) >= k)
    good_l = (F.size(f) >= 6) & at(1).rlike(name) & at(2).rlike(sign) & at(3).rlike(name) & at(4).rlike(sign) & (at(5) == f"{k - 1}M")
    bad = rows.where(((at(0) == "S") & ~F.coalesce(good_s, F.lit(False))) | ((at(0) == "L") & ~F.coalesce(good_l, F.lit(False))))
    if found := bad.select("value").take(1):
        raise ValueError(f"{found[0][0]!r} is no line of a graph of k={k}")
    number = lambda i: F.substring(at(i), 2, 20).cast("long")
    segments = rows.where(at(0) == "S").select(number(1).alias("unitig_id"), at(2).alias("seq"))
    if twice := segments.groupBy("unitig_id").count().where("count > 1").take(1):
        raise ValueError(f"segment u{twice[0][0]} is given twice")
    listed = rows.where(at(0) == "L").select(number(1).alias("a"), at(2).alias("a_strand"), number(3).alias("b"), at(4).alias("b_strand"))
    true = graph.both_ways(graph.gfa_links(segments, k))
    lacking, extra = true.subtract(listed), listed.subtract(true)
    return lacking.select(F.lit("missing").alias("problem"), "*").unionByName(extra.select(F.lit("false").alias("problem"), "*"))


def dump_sums(spark: SparkSession, prefix: str) -> dict[str, int]:
    """What two dumps of equal indexes share: k, the number of k-mers with repeats, and checksums of k-mers and of k-mers with their sets.

    A k-mer counts as its reverse complement does, and the order and orientation of unitigs and the numbers of sets do not count.
    """
    x = formats.load_dump(spark, *(f"{prefix}.{n}" for n in ("unitigs.fa", "color_sets.txt", "metadata.txt")))
    spelled = formats.unitig_rows(spark, f"{prefix}.unitigs.fa")
    n = spelled.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - x.k + 1, F.lit(0))), F.lit(0))).first()[0]
    kmer = research.checksum(x.kmers, F.col("kmer")).first()
    pair = research.checksum(x.kmers, F.concat("kmer", F.lit(" "), F.array_join(F.transform("colors", lambda c: c.cast("string")), ","))).first()
    return {"k": x.k, "n_kmers": n, **{f"kmers_{c}": kmer[c] for c in ("n", "c0", "c1", "c2")}, **{f"sets_{c}": pair[c] for c in ("c0", "c1", "c2")}}


def different(spark: SparkSession, first: str, second: str) -> list[str]:
    """What of dump_sums differs between two dumps."""
    a, b = dump_sums(spark, first), dump_sums(spark, second)
    return [f"{c}: {a[c]} and {b[c]}" for c in a if a[c] != b[c]]
