"""FASTA and FASTQ, pseudoalignment records, color lists, and text dumps of an index."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.functions.seq import canonical, kmers, revcomp
from prismer.operators import graph
from prismer.operators.index import Index, numbered

RECORD = "name string, colors array<bigint>, kmer_hits array<bigint>, bases_covered array<bigint>"


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ordinal, name, comment, seq) of FASTA records; ordinal counts a file's records from 0.

    Files are split at record marks by Spark's text reader; .gz files are read whole.
    """
    paths = [paths] if isinstance(paths, str) else paths
    marks = spark.read.option("lineSep", "\n>").text(paths).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    rows = marks.where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_replace(F.regexp_extract(body, r"^[^\n]*", 0), "\r", ""))
    seq = F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", ""))
    from pyspark.sql import Window

    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("block", "_at")) - 1
    return rows.select("path", ordinal.cast("long").alias("ordinal"), F.substring_index(head, " ", 1).alias("name"), F.when(head.contains(" "), F.regexp_replace(head, r"^\S*\s+", "")).otherwise("").alias("comment"), seq.alias("seq"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ordinal, name, seq, qual) of four-line FASTQ records; plain or .gz."""
    from pyspark.sql import Window

    paths = [paths] if isinstance(paths, str) else paths
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    n = F.row_number().over(Window.partitionBy("path").orderBy("block", "_at")) - 1
    rows = lines.withColumn("_n", n).groupBy("path", F.floor(F.col("_n") / 4).cast("long").alias("ordinal")).agg(*[F.max(F.when(F.col("_n") % 4 == i, F.col("value"))).alias(f"_{i}") for i in (0, 1, 3)])
    return rows.select("path", "ordinal", F.substring_index(F.substring("_0", 2, 1 << 20), " ", 1).alias("name"), F.upper(F.trim("_1")).alias("seq"), F.col("_3").alias("qual"))


def is_fastq(path: str) -> bool:
    """By extension, before a .gz."""
    return re.search(r"\.(fq|fastq)(\.gz)?$", path, re.IGNORECASE) is not None


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ordinal, name, seq, qual) of FASTA and FASTQ files by extension; qual is null for FASTA."""
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for some, read in (([p for p in paths if is_fastq(p)], read_fastq), ([p for p in paths if not is_fastq(p)], read_fasta)):
        if some:
            rows = read(spark, some)
            rows = rows.select("path", "ordinal", "name", "seq", F.col("qual") if "qual" in rows.columns else F.lit(None).cast("string").alias("qual"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no files")
    return out


def pairs_of_lists(queries: list[str], outputs: list[str]) -> list[tuple[str, str]]:
    """Query files with their output files, line by line; lists of different lengths are an error."""
    if len(queries) != len(outputs):
        raise ValueError(f"{len(queries)} query files but {len(outputs)} output files")
    return list(zip(queries, outputs))


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a list, one a line, blank lines left out."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def file_colors(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(color, seq) and (color, name) with one color a FASTA file, in the order given."""
    if not paths:
        raise ValueError("no files")
    names = spark.createDataFrame(list(enumerate(paths)), "color int, name string")
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def whole(path: str) -> str:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^file:/+", "file:/", p.getFileSystem(conf).makeQualified(p).toUri().toString())

    # one scan of all files, whatever their number; a file's name tells its color
    of = spark.createDataFrame([(i, whole(p)) for i, p in enumerate(paths)], "color int, path string")
    rows = read_sequences(spark, list(dict.fromkeys(paths))).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return rows.join(of, "path").select("color", "seq"), names


def with_reverse(sequences: DataFrame) -> DataFrame:
    """The sequences, then their reverse complements, with the other columns of each."""
    return sequences.unionByName(sequences.withColumn("seq", revcomp(F.col("seq"))))


def sequence_colors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(color, seq) and (color, name) with one color a record of a FASTA file, in its order."""
    rows = read_fasta(spark, path).withColumn("color", F.col("ordinal").cast("int"))
    return rows.select("color", "seq"), rows.select("color", "name")


def colors_from(spark: SparkSession, files: list[str] | None = None, sequences: str | None = None) -> tuple[DataFrame, DataFrame]:
    """File colors or sequence colors; exactly one must be given."""
    if (files is None) == (sequences is None):
        raise ValueError("give either files or sequences")
    return file_colors(spark, files) if files is not None else sequence_colors(spark, sequences)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, name, colors, kmer_hits, bases_covered) of pseudoalignment JSON lines; a malformed line is an error."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path).select(F.monotonically_increasing_id().alias("query_idx"), "*")


def read_color_list(spark: SparkSession, path: str) -> list[int]:
    """Color ids, one a line; blank lines are skipped, anything else, negative numbers too, is an error."""
    lines = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]
    if bad := [x for x in lines if not x.isascii() or not x.isdigit()]:
        raise ValueError(f"{bad[0]!r} is no color id")
    return [int(x) for x in lines]


def json_lines(rows: DataFrame, positive_only: bool = False, key: str = "query_idx") -> DataFrame:
    """(value): a JSON object a record with name, colors and the metrics that rows has, in query order."""
    rows = rows.where(F.size("colors") > 0) if positive_only else rows
    names = [c for c in ("name", "colors", "kmer_hits", "bases_covered") if c in rows.columns]
    return rows.orderBy(key).select(F.to_json(F.struct(*names)).alias("value"))


def plain_lines(rows: DataFrame, positive_only: bool = False, key: str = "query_idx") -> DataFrame:
    """(value): the query's number and its colors, separated by spaces, in query order; metrics are an error."""
    if {"kmer_hits", "bases_covered"} & set(rows.columns):
        raise ValueError("the plain format has no metrics")
    rows = rows.where(F.size("colors") > 0) if positive_only else rows
    return rows.orderBy(key).select(F.concat_ws(" ", F.col(key).cast("string"), F.transform("colors", lambda c: c.cast("string"))).alias("value"))


def color_set_lines(found: DataFrame, with_kmer: bool = False, key: str = "query_idx") -> DataFrame:
    """(key, pos, value): the colors at each place, after the k-mer if asked for; unknown and empty sets are blank."""
    colors = F.coalesce(F.array_join(F.transform("colors", lambda c: c.cast("string")), " "), F.lit(""))
    return found.select(key, "pos", (F.concat_ws(" ", "kmer", colors) if with_kmer else colors).alias("value"))


def dump(index: Index, unitigs: bool = True) -> dict[str, DataFrame]:
    """Text lines (value) of an index: unitigs (FASTA by canonical colored unitig), color_sets, metadata, gfa.

    Without unitigs neither they nor the graph are made, and the metadata leaves out their number.
    """
    sets = index.sets().select("set_id", "size", "colors").persist()
    sizes = [f"num_colors={index.n_colors}", f"num_color_sets={sets.count()}", f"k={index.k}"]
    if not unitigs:
        return _dump_sets(index, sets, sizes)
    units = numbered(graph.canonical_unitigs(index), "unitig_id", ["seq"]).join(sets.select("set_id", "colors"), "colors").select("unitig_id", "seq", "n_kmers", "set_id").persist()
    text = lambda c: c.cast("string")
    links = graph.both_ways(graph.gfa_links(units, index.k))
    gfa = index.spark.createDataFrame([(0, 0, "H\tVN:Z:1.0")], "o int, i long, value string").unionAll(units.select(F.lit(1), "unitig_id", F.format_string("S\tu%d\t%s\tcs:i:%d", "unitig_id", "seq", "set_id"))).unionAll(links.select(F.lit(2), "a", F.format_string(f"L\tu%d\t%s\tu%d\t%s\t{index.k - 1}M", "a", "a_strand", "b", "b_strand")))
    return _dump_sets(index, sets, [f"num_unitigs={units.count()}", *sizes]) | {
        "unitigs": units.orderBy("unitig_id").select(F.concat(F.lit("> unitig_id="), text(F.col("unitig_id")), F.lit(" color_set_id="), text(F.col("set_id")), F.lit("\n"), "seq").alias("value")),
        "gfa": gfa.orderBy("o", "i", "value").select("value"),
    }


def _dump_sets(index: Index, sets: DataFrame, meta: list[str]) -> dict[str, DataFrame]:
    text = lambda c: c.cast("string")
    return {
        "color_sets": sets.orderBy("set_id").select(F.concat_ws(" ", F.concat(F.lit("color_set_id="), text(F.col("set_id"))), F.concat(F.lit("size="), text(F.col("size"))), F.transform("colors", text)).alias("value")),
        "metadata": index.spark.createDataFrame([(x,) for x in meta], "value string"),
    }


def unitig_rows(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, seq) of dumped unitigs."""
    units = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    return units.select(F.regexp_extract("value", r"color_set_id=(\d+)", 1).cast("long").alias("set_id"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("seq"))


def load_dump(spark: SparkSession, unitigs: str, color_sets: str, metadata: str) -> Index:
    """An index from dumped unitigs, color sets and metadata; colors are named by their numbers."""
    meta = dict(r[0].split("=", 1) for r in spark.read.text(metadata).collect() if r[0].strip())
    known = {"num_colors", "num_unitigs", "num_color_sets", "k"}
    if meta.keys() - known or known - {"num_unitigs"} - meta.keys():
        raise ValueError(f"metadata has {sorted(meta)}")
    k, n = int(meta["k"]), int(meta["num_colors"])
    parts = F.split(F.trim("value"), " ")
    sets = spark.read.text(color_sets).where(F.length(F.trim("value")) > 0).select(F.regexp_extract("value", r"color_set_id=(\d+)", 1).cast("long").alias("set_id"), F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: c.cast("int")).alias("colors"))
    if sets.count() != int(meta["num_color_sets"]):
        raise ValueError("the number of color sets differs from the metadata")
    sizes = spark.read.text(color_sets).where(F.length(F.trim("value")) > 0).select(F.regexp_extract("value", r"size=(\d+)", 1).cast("int").alias("size"), F.size(parts).alias("n"))
    if sizes.where("size is null or size != n - 2").take(1):
        raise ValueError("a color set's size differs from its colors")
    rows = unitig_rows(spark, unitigs)
    if unknown := rows.join(sets.select("set_id"), "set_id", "left_anti").select("set_id").take(1):
        raise ValueError(f"unitigs name the unknown color set {unknown[0][0]}")
    table = rows.select("set_id", F.explode(kmers(F.col("seq"), k)).alias("kmer")).select(canonical(F.col("kmer")).alias("kmer"), "set_id").distinct().join(sets, "set_id").select("kmer", F.array_sort("colors").alias("colors"))
    return Index(k, table, spark.range(n).select(F.col("id").cast("int").alias("color"), F.col("id").cast("string").alias("name")))


def write_lines(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """Lines of text to a folder, gzipped on demand."""
    rows.select("value").write.option("compression", "gzip" if gzip else "none").text(path)


def report_json(each: DataFrame, totals: DataFrame) -> str:
    """The report as JSON; colors of no positive read are left out, the most frequent come first."""
    n, rows = totals.first(), each.collect()
    pairs = lambda c: [[r["name"], r[c]] for r in sorted(rows, key=lambda r: (-r[c], r["color"])) if r[c]]
    return json.dumps({"n_reads": n.n_reads, "n_positive_reads": n.n_positive_reads, "positive_by_color": pairs("positive"), "unique_positive_by_color": pairs("unique_positive")}, indent=2, ensure_ascii=False)


def name_lines(colors: DataFrame) -> DataFrame:
    """(value): a color's id and name, separated by a tab, in order."""
    return colors.orderBy("color").select(F.concat_ws("\t", F.col("color").cast("string"), "name").alias("value"))


def table_lines(rows: DataFrame) -> list[str]:
    """A header and tab-separated rows of a small table."""
    return ["\t".join(rows.columns), *("\t".join(map(str, r)) for r in rows.collect())]


def sequence_lines(reads: DataFrame, path: str) -> DataFrame:
    """FASTQ or FASTA lines as the output's extension says; FASTQ needs qualities."""
    if is_fastq(path):
        if reads.where("qual is null").take(1):
            raise ValueError("FASTQ output needs reads with qualities")
        return fastq_lines(reads)
    return fasta_lines(reads)


def fasta_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
