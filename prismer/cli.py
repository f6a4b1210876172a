"""The command line: python -m prismer.cli COMMAND ...

Indexes are folders of Parquet tables. Output goes to a folder of text parts (gzipped where its name
ends in .gz) that tasks write side by side; without an output it is printed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.operators import align, index, research, verify
from prismer.operators.index import Index
from prismer.plans.storage import stored
from prismer.sources import formats


def _lines(rows: DataFrame, output: str | None) -> None:
    if output:
        formats.write_lines(rows, output, output.endswith(".gz"))
    else:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            print(r.value)


def _text(spark: SparkSession, lines: list[str], output: str | None) -> None:
    _lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), output)


def _reads(spark: SparkSession, path: str) -> DataFrame:
    return formats.read_sequences(spark, path).select(F.col("ordinal").alias("query_idx"), "name", "seq", "qual")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.from_unitigs and a.k % 2 == 0:
        raise ValueError("--from-unitigs needs an odd k")
    files = formats.read_file_list(spark, a.file_colors) if a.file_colors else None
    rows, names = formats.colors_from(spark, files, a.seq_colors)
    if not a.to_disk_in_pieces:
        index.save(index.build(rows, a.k, names), a.output)
        return
    # pieces by ranges of colors, each a whole index that merge takes
    n = names.count()
    for i in range(a.to_disk_in_pieces):
        low, high = n * i // a.to_disk_in_pieces, n * (i + 1) // a.to_disk_in_pieces
        part = F.col("color").between(low, high - 1)
        index.save(index.build(rows.where(part).withColumn("color", F.col("color") - low), a.k, names.where(part).withColumn("color", F.col("color") - low)), f"{a.output}.{i}")


def _queries(spark: SparkSession, a: argparse.Namespace) -> list[tuple[str, str | None]]:
    """Pairs of query and output."""
    if (a.query is None) == (a.query_list is None):
        raise ValueError("give either --query or --query-list")
    if a.query_output_list and not a.query_list:
        raise ValueError("--query-output-list needs --query-list")
    if a.output and a.query_list:
        raise ValueError("--output goes with --query")
    if a.query:
        return [(a.query, a.output)]
    queries = formats.read_file_list(spark, a.query_list)
    if a.query_output_list:
        return formats.pairs_of_lists(queries, formats.read_file_list(spark, a.query_output_list))
    return [(q, None) for q in queries]


def _aligned(spark: SparkSession, a: argparse.Namespace, how) -> None:
    x = index.load(spark, a.index)
    if a.plain and (a.report_hit_counts or a.report_bases_covered):
        raise ValueError("the plain format has no metrics")
    for query, output in _queries(spark, a):
        reads = _reads(spark, query)
        counted = tuple(map(stored, align.color_counts(x, reads)))
        metrics = {"kmer_hits": counted[0]} if a.report_hit_counts else {}
        if a.report_bases_covered:
            metrics["bases_covered"] = align.bases_covered(x, reads)
        rows = align.records(reads, how(x, reads, counted), metrics)
        _lines((formats.plain_lines if a.plain else formats.json_lines)(rows, a.positive_reads_only), output)


def intersection_pseudoalign(spark: SparkSession, a: argparse.Namespace) -> None:
    _aligned(spark, a, lambda x, reads, _: align.intersection(x, reads, a.min_hits))


def threshold_pseudoalign(spark: SparkSession, a: argparse.Namespace) -> None:
    _aligned(spark, a, lambda x, reads, counted: align.threshold(x, reads, a.threshold, a.denominator, a.min_hits, counted=counted))


def print_color_sets(spark: SparkSession, a: argparse.Namespace) -> None:
    found = align.hits(index.load(spark, a.index), _reads(spark, a.query))
    _lines(formats.color_set_lines(found, a.print_kmers).orderBy("query_idx", "pos"), a.output)


def dump_color_names(spark: SparkSession, a: argparse.Namespace) -> None:
    _lines(formats.name_lines(index.load_names(spark, a.index)), a.output)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    index.save(index.merge([index.load(spark, p) for p in formats.read_file_list(spark, a.index_file_list)]), a.output)


def import_(spark: SparkSession, a: argparse.Namespace) -> None:
    index.save(formats.load_dump(spark, *(f"{a.color_dump_prefix}.{x}" for x in ("unitigs.fa", "color_sets.txt", "metadata.txt"))), a.output)


def import_sbwt(spark: SparkSession, a: argparse.Namespace) -> None:
    """A plain set of k-mers, one a FASTA record, as an index of one color."""
    rows = formats.read_fasta(spark, a.kmers).select("seq")
    k = rows.agg(F.max(F.length("seq")), F.min(F.length("seq"))).first()
    if k[0] is None or k[0] != k[1]:
        raise ValueError("the k-mers differ in length")
    index.save(index.build_one_color(rows, k[0], a.color_name), a.output)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = formats.dump(index.load(spark, a.index), not a.no_unitigs)
    names = {"metadata": "metadata.txt"}
    if not a.no_unitigs:
        names |= {"gfa": "unitigs.gfa"} if a.gfa else {"unitigs": "unitigs.fa"}
    if not a.no_color_sets and not a.colors_to_stdout:
        names["color_sets"] = "color_sets.txt"
    for what, name in names.items():
        formats.write_lines(lines[what], f"{a.output_prefix}.{name}")
    if a.colors_to_stdout and not a.no_color_sets:
        _lines(lines["color_sets"], None)


def verify_gfa_links(spark: SparkSession, a: argparse.Namespace) -> None:
    if wrong := verify.wrong_links(spark.read.text(a.gfa), a.kmer_length).take(5):
        raise ValueError("; ".join(f"{r.problem} link u{r.a}{r.a_strand} u{r.b}{r.b_strand}" for r in wrong))
    print("every link is right and none is missing")


def compare_dumps(spark: SparkSession, a: argparse.Namespace) -> None:
    if found := verify.different(spark, a.first, a.second):
        raise ValueError("the dumps differ: " + "; ".join(found))
    print("the dumps are equal")


def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    x = index.load(spark, a.index)
    _text(spark, formats.table_lines(index.stats(x).unionByName(index.unitig_lengths(x))), None)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    each, totals = align.report(formats.read_records(spark, a.input), index.load_names(spark, a.index))
    _text(spark, formats.report_json(each, totals).split("\n"), a.output)


def filter_reads(spark: SparkSession, a: argparse.Namespace) -> None:
    reads, records = _reads(spark, a.reads), stored(formats.read_records(spark, a.pseudoalignment))
    for what, rows in (("reads", reads), ("records", records)):
        if twice := rows.groupBy("name").count().where("count > 1").orderBy("name").take(5):
            print(f"warning: several {what} are named {', '.join(r['name'] for r in twice)}", file=sys.stderr)
    kept = align.filter_reads(reads, records, formats.read_color_list(spark, a.colors)).orderBy("query_idx")
    _lines(formats.sequence_lines(kept, a.output), a.output)


def finimizer_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    _text(spark, formats.table_lines(research.finimizer_stats(index.load(spark, a.index))), None)


def minimizer_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    x: Index = index.load(spark, a.index)
    if not 0 < a.m <= x.k:
        raise ValueError(f"m must be from 1 to {x.k}")
    _text(spark, formats.table_lines(research.minimizer_stats(x, a.m)), None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prismer", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for *flags, more in options:
            c.add_argument(*flags, **more)
        return c

    need, flag = {"required": True}, {"action": "store_true"}
    own = ("--index", "-i", need)
    out = ("--output", "-o", {})
    align_options = (
        own, ("--query", "-q", {}), out, ("--query-list", {}), ("--query-output-list", {}), ("--min-hits", "-m", {"type": int, "default": 1}), ("--report-hit-counts", flag),
        ("--positive-reads-only", flag), ("--sort-output", {**flag, "help": "output is always in the order of the queries"}), ("--plain", flag), ("--report-bases-covered", flag),
    )
    command("build", build, ("--file-colors", {}), ("--seq-colors", {}), ("--output", "-o", need), ("-k", {"type": int, "required": True}), ("--from-unitigs", flag), ("--to-disk-in-pieces", {"type": int, "default": 0}))
    command("intersection-pseudoalign", intersection_pseudoalign, *align_options)
    command("threshold-pseudoalign", threshold_pseudoalign, *align_options, ("--threshold", "-d", {"type": float, "required": True}), ("--denominator", "-n", {"choices": ["all", "relevant", "max-hits"], "required": True}))
    command("print-color-sets", print_color_sets, own, ("--query", "-q", need), ("--print-kmers", "-p", flag), out)
    command("dump-color-names", dump_color_names, own, out)
    command("merge", merge, ("--index-file-list", need), ("--output", "-o", need))
    command("import", import_, ("--color-dump-prefix", "-c", need), ("--output", "--out", "-o", need))
    command("import-sbwt", import_sbwt, ("--kmers", "-s", need), ("--output", "-o", need), ("--color-name", need))
    command("export", export, own, ("--output-prefix", "-o", need), ("--gfa", flag), ("--colors-to-stdout", flag), ("--no-unitigs", flag), ("--no-color-sets", flag))
    command("verify-gfa-links", verify_gfa_links, ("gfa", {}), ("-k", "--kmer-length", {"type": int, "required": True}))
    command("compare-dumps", compare_dumps, ("first", {}), ("second", {}))
    command("stats", stats, own)
    command("report", report, own, ("--input", need), out)
    command("filter-reads", filter_reads, ("--reads", need), ("--pseudoalignment", need), ("--colors", need), ("--output", "-o", need))
    command("finimizer-stats", finimizer_stats, own)
    command("minimizer-stats", minimizer_stats, own, ("-m", {"type": int, "required": True}))
    return p


def main(args: list[str], spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("prismer").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
