"""Pseudoalignment of reads against an index, its metrics, reports and read filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismer.functions.seq import canonical, positions
from prismer.operators.index import Index


def hits(index: Index, reads: DataFrame, key: str = "query_idx") -> DataFrame:
    """(key, pos, kmer, colors) for every place of every read; colors is null where the k-mer is unknown.

    Distinct query k-mers meet the index, so a k-mer that is frequent in the reads is one row; see Index.known.
    """
    places = positions(reads, index.k, key).withColumn("_c", canonical(F.col("kmer")))
    known = index.known(places.select(F.col("_c").alias("kmer"))).withColumnRenamed("kmer", "_c")
    return places.join(known, "_c", "left").select(key, "pos", "kmer", "colors")


def color_counts(index: Index, reads: DataFrame, key: str = "query_idx") -> tuple[DataFrame, DataFrame]:
    """(key, color, hits), and (key, n_all, n_rel) for reads with any place; counted by distinct k-mer before colors are unnested."""
    places = positions(reads, index.k, key).groupBy(key, canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))
    known = index.known(places.select("kmer"))
    met = places.join(known, "kmer", "left")
    totals = met.groupBy(key).agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("colors").isNotNull(), F.col("n")).otherwise(0)).alias("n_rel"))
    sets = met.where("colors is not null").groupBy(key, "colors").agg(F.sum("n").alias("n"))
    return sets.select(key, F.explode("colors").alias("color"), "n").groupBy(key, "color").agg(F.sum("n").alias("hits")), totals


def threshold(index: Index, reads: DataFrame, threshold: float, denominator: str = "all", min_hits: int = 1, key: str = "query_idx", counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, color, hits, n_all, n_rel): colors whose hits over the denominator reach the threshold.

    The denominator is all places, the relevant (known) ones, or the read's greatest count ("max-hits").
    Reads with fewer relevant places than min_hits have no color. The division is in doubles.
    counted: what color_counts gave, if it is known.
    """
    if denominator not in ("all", "relevant", "max-hits"):
        raise ValueError(f"unknown denominator {denominator!r}")
    counts, totals = counted or color_counts(index, reads, key)
    rows = counts.join(totals, key).where(F.col("n_rel") >= min_hits)
    most = {"all": F.col("n_all"), "relevant": F.col("n_rel"), "max-hits": F.max("hits").over(Window.partitionBy(key))}[denominator]
    return rows.withColumn("_d", most.cast("double")).where(F.col("hits") / F.col("_d") >= threshold).drop("_d")


def runs(found: DataFrame, key: str = "query_idx") -> DataFrame:
    """(key, runs): how many runs of equal known color sets follow each other along a read."""
    order = Window.partitionBy(key).orderBy("pos")
    starts = F.col("colors").isNotNull() & ((F.col("pos") == 0) | ~F.col("colors").eqNullSafe(F.lag("colors").over(order)))
    return found.withColumn("_s", starts.cast("long")).groupBy(key).agg(F.sum("_s").alias("runs"))


def intersection(index: Index, reads: DataFrame, min_hits: int = 1, key: str = "query_idx") -> DataFrame:
    """(key, color): colors of every known k-mer of a read that has at least min_hits runs of known sets.

    With min_hits 0 a read without known k-mers has all colors.
    """
    found = hits(index, reads, key)
    known = found.where("colors is not null")
    need = known.groupBy(key).agg(F.count("*").alias("n_rel")).join(runs(found, key), key).where(F.col("runs") >= min_hits)
    each = known.groupBy(key, "colors").count().select(key, F.explode("colors").alias("color"), "count").groupBy(key, "color").agg(F.sum("count").alias("hits"))
    out = each.join(need, key).where("hits = n_rel").select(key, "color")
    if min_hits > 0:
        return out
    without = reads.select(key).join(known.select(key).distinct(), key, "left_anti")
    return out.unionByName(without.crossJoin(F.broadcast(index.colors.select("color"))))


def bases_covered(index: Index, reads: DataFrame, key: str = "query_idx") -> DataFrame:
    """(key, color, bases): bases that the k-mers of a color cover together."""
    each = hits(index, reads, key).where("colors is not null").select(key, "pos", F.explode("colors").alias("color"))
    before = F.lag("pos").over(Window.partitionBy(key, "color").orderBy("pos"))
    new = F.least(F.lit(index.k), F.coalesce(F.col("pos") - before, F.lit(index.k)))
    return each.withColumn("_n", new).groupBy(key, "color").agg(F.sum("_n").cast("long").alias("bases"))


def records(reads: DataFrame, aligned: DataFrame, metrics: dict[str, DataFrame] | None = None, key: str = "query_idx") -> DataFrame:
    """(key, name, colors and each metric as an array): one row a read, in any order; reads without colors have empty arrays.

    metrics: by name frames (key, color, value).
    """
    rows = aligned.select(key, "color")
    names = sorted(metrics or {})
    for m in names:
        rows = rows.join(metrics[m].toDF(key, "color", m), [key, "color"], "left").fillna(0, [m])
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("color", *names))).alias("_r"))
    out = reads.select(key, "name").join(gathered, key, "left")
    empty = F.array().cast("array<bigint>")
    part = lambda c: F.coalesce(F.transform("_r", lambda r: r[c].cast("long")), empty).alias(c if c != "color" else "colors")
    return out.select(key, "name", part("color"), *[part(m) for m in names])


def report(rows: DataFrame, colors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From records: (color, name, positive, unique_positive) by falling positive, and one row (n_reads, n_positive_reads)."""
    totals = rows.agg(F.count("*").alias("n_reads"), F.count_if(F.size("colors") > 0).alias("n_positive_reads"))
    each = rows.select(F.explode("colors").alias("color"), F.size("colors").alias("_n")).groupBy("color").agg(F.count("*").alias("positive"), F.count_if(F.col("_n") == 1).alias("unique_positive"))
    return each.join(colors, "color").select("color", "name", "positive", "unique_positive").orderBy(F.desc("positive"), "color"), totals


def filter_reads(reads: DataFrame, rows: DataFrame, targets: list[int]) -> DataFrame:
    """The reads whose record, by name, has a target color; of several records of a name the last counts.

    A read without a record or a record without a read is an error. Reads of one name are all kept.
    """
    last = rows.groupBy("name").agg(F.max_by("colors", "query_idx").alias("colors"))
    if name := reads.join(last, "name", "left_anti").select("name").take(1):
        raise ValueError(f"no pseudoalignment of read {name[0][0]!r}")
    if name := last.join(reads, "name", "left_anti").select("name").take(1):
        raise ValueError(f"no read for pseudoalignment {name[0][0]!r}")
    wanted = last.where(F.arrays_overlap("colors", F.array(*[F.lit(t).cast("long") for t in targets]))) if targets else last.limit(0)
    return reads.join(wanted.select("name"), "name", "left_semi")
