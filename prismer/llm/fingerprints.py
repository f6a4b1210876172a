"""Bottom-k sketches of word-shingle hashes, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5
#: Hashes are taken as 64-bit numbers; their least k distinct ones are kept.
SPAN = 2.0**64


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Hashes of each run of width words; of all words where they are fewer; none without words."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(docs: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """docs and a column name with the sketch of column text: the k least distinct hashes, ascending.

    Of many hashes only those in the least part of their range are sorted: four times the share
    that k of them should take. Where that part holds fewer than k distinct ones, all are sorted.
    """
    s, n = F.col("_s"), F.size("_s")
    cut = (F.lit(-(2.0**63)) + F.lit(SPAN * 4 * k) / n).cast("long")
    rows = docs.withColumn("_w", words(F.col(text))).withColumn("_s", shingles(F.col("_w"), width))
    rows = rows.withColumn("_l", F.when(n >= 8 * k, F.array_distinct(F.filter(s, lambda h: h < cut))))
    rows = rows.withColumn("_l", F.when(F.coalesce(F.size("_l"), F.lit(0)) >= k, F.col("_l")).otherwise(F.array_distinct(s)))
    return rows.withColumn(name, F.slice(F.sort_array("_l"), 1, k)).drop("_w", "_s", "_l")


def joined(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold; 1 for two empty sets."""
    both, either = F.array_intersect(a, b), F.array_union(a, b)
    top = F.slice(F.sort_array(either), 1, k)
    shared = F.size(F.filter(both, lambda x: x <= F.element_at(top, -1)))
    return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(shared / F.size(top))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and counts."""
    r = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * distinct_count(joined(a, b, k), k) / distinct_count(a, k)))


def merged(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts; tasks keep only the k least hashes of a key before the shuffle.

    Null and empty sketches add nothing; a key that has no other gets an empty sketch. Null keys are a key of their own.
    """
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("_h"))
    least = parts.select(key, F.explode_outer(sketch).alias("_h")).withColumn("_r", rank).where(F.col("_r") <= k + 1)
    return least.groupBy(key).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketch))


def as_text(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, ascending as signed numbers, joined by dots."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ".")


def _below(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are less than x, by blocks of the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[::step]).cast("array<bigint>"), lambda b: b < x))
    block = F.slice(F.lit(bounds).cast("array<bigint>"), F.greatest(F.lit(1), (coarse - 1) * step + 2), step - 1) if step > 1 else None
    inside = F.size(F.filter(block, lambda b: b < x)) if step > 1 else F.lit(0)
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + 1 + inside)


def beside_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """docs, and for each of columns next_<column>: its value in the next row by descending key, after the last row the first.

    Rows are dealt to ranges of the key whose bounds are keys that occur (an approximate
    percentile: bounded memory); a range's first row is also sent to the range before it, so every
    next row is found within a range by one shuffle. Equal keys are ordered by columns; null keys
    come last.
    """
    spark = docs.sparkSession
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(key, F.lit([i / many for i in range(1, many + 1)]), F.lit(max(10_000, 10 * many))).alias("p"), F.max(key).alias("m")).first()
    bounds = sorted({*(found.p or []), found.m} - {None}) if found else []
    if bounds:
        home = F.when(F.col(key).isNull(), F.lit(0)).otherwise(_below(bounds, F.col(key)))
        first = F.col(key) == F.element_at(F.lit(bounds).cast("array<bigint>"), F.col("_home") + 1)
    else:
        home, first = F.lit(0), F.lit(True)
    n = max(1, len(bounds))
    kept = F.struct(F.col("_home").alias("_range"), F.lit(False).alias("_tail"))
    sent = F.struct(((F.col("_home") + 1) % n).alias("_range"), F.lit(True).alias("_tail"))
    dealt = docs.withColumn("_home", home).withColumn("_to", F.explode(F.when(first, F.array(kept, sent)).otherwise(F.array(kept)))).select("*", "_to.*").drop("_to", "_home")
    order = Window.partitionBy("_range").orderBy("_tail", F.col(key).desc_nulls_last(), *columns)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not _tail").drop("_range", "_tail")


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, text and sketch of every document; null text is empty and has an empty sketch.

    Rows keep their order and number, repeated ones too; other columns are left out. No shuffle.
    """
    return with_sketch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "sketch", k, width)


def edited_pairs(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text, of its edited text (last third replaced from the next document) and their likeness.

    One row for each row of docs. Null texts are empty; two empty shingle sets are alike by 1, an empty
    and another by 0. Rows of equal doc_id follow each other by text; null doc_ids come last; the last
    row's next one is the first, a single row's is itself. An empty table stays empty. Other columns are left out.
    """
    rows = beside_next(fingerprints(docs, k, width), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))).drop("text", "next_text")
    both = with_sketch(edited, "edited", "edited_sketch", k, width)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
