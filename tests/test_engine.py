"""The engine against hand-made fixtures and brute force."""

import pytest
from pyspark.sql import functions as F

from prismer.functions.seq import kmers, revcomp
from prismer.operators import align, graph, index, research
from prismer.sources import formats

READS = {
    "C1.1": (0, "ACGACATCTACTACTAGTCGACTAC"),
    "C1.2": (0, "ACAACTTTACGACTATCGTACTGATCA"),
    "C2.1": (1, "ACACATCTCATCAGTAGTCAGTCGCAGCTAGCAATCTAC"),
    "C2.2": (1, "CATCCTATCGCTAGCTACGTCAGTCAGA"),
    "C2.3": (1, "ACAACTTTACGACTATCGTACTGATCAAAAACGACATCTACTACTAGTCGACTAC"),
    "C3.1": (2, "CATCTTCTAGTCGTATCTACACGTCGGATCGTACTGTACGACT"),
    "C3.2": (2, "ACACACAACTTTACGACTATCGTACTGATCA"),
}
THRESHOLD = {"C1.1": [0, 1], "C1.2": [0, 1, 2], "C2.1": [1], "C2.2": [1], "C2.3": [0, 1], "C3.1": [2], "C3.2": [0, 1, 2]}
INTERSECTION = {"C1.1": [0, 1], "C1.2": [0, 1, 2], "C2.1": [1], "C2.2": [1], "C2.3": [1], "C3.1": [2], "C3.2": [2]}


def table(spark):
    return spark.createDataFrame([(i, n, c, s) for i, (n, (c, s)) in enumerate(READS.items())], "query_idx long, name string, color int, seq string")


@pytest.fixture(scope="module")
def built(spark):
    x = index.build(table(spark).select("color", "seq"), 5)
    return index.Index(5, x.kmers.persist(), x.colors.persist())


def by_name(rows):
    return {r["name"]: list(r.colors) for r in rows.collect()}


def test_thresholds_and_intersection(spark, built):
    reads = table(spark)
    for den in ("all", "relevant", "max-hits"):
        assert by_name(align.records(reads, align.threshold(built, reads, 0.7, den))) == THRESHOLD
    assert by_name(align.records(reads, align.intersection(built, reads))) == INTERSECTION
    runs = {r.query_idx: r.runs for r in align.runs(align.hits(built, reads)).collect()}
    assert [runs[i] for i in range(7)] == [8, 1, 14, 7, 10, 11, 5]
    none = spark.createDataFrame([(9, "x", "NNNNNNN"), (10, "y", "AC")], "query_idx long, name string, seq string")
    assert by_name(align.records(none, align.intersection(built, none, min_hits=0))) == {"x": [0, 1, 2], "y": [0, 1, 2]}
    assert by_name(align.records(none, align.threshold(built, none, 0.0))) == {"x": [], "y": []}


def test_index_counts_and_unitigs(spark, built):
    got = {r.metric: r.value for r in index.stats(built).collect()}
    assert (got["n_kmers"], got["n_color_sets"], got["n_noncyclic_unitigs"]) == (194, 5, 127)
    assert abs(got["mean_set_size_per_kmer"] - 1.608247) < 1e-6
    units = graph.unitigs(built.both_strands(), 5).collect()
    assert len(units) == 127 and sum(u.n_kmers for u in units) == 194
    assert graph.colored_unitigs(built).count() == 129


def test_cyclic_unitig(spark):
    rows = spark.createDataFrame([(0, "AACCGAACCGAACCG"), (1, "AACCG")], "color int, seq string")
    x = index.build(rows, 4)
    assert sorted(u.n_kmers for u in graph.unitigs(x.both_strands(), 4).collect()) == [5, 5]
    assert graph.colored_unitigs(x).count() >= 4


def test_merge_save_load_and_dump(spark, built, tmp_path):
    seqs = table(spark)
    parts = [index.build(seqs.where("color = 0").select("color", "seq"), 5), index.build(seqs.where("color > 0").select((F.col("color") - 1).alias("color"), "seq"), 5)]
    want = {r.kmer: list(r.colors) for r in built.kmers.collect()}
    assert {r.kmer: list(r.colors) for r in index.merge(parts).kmers.collect()} == want
    index.save(built, str(tmp_path / "i"))
    assert {r.kmer: list(r.colors) for r in index.load(spark, str(tmp_path / "i")).kmers.collect()} == want
    for name, lines in formats.dump(built).items():
        formats.write_lines(lines, str(tmp_path / name))
    again = formats.load_dump(spark, *(str(tmp_path / n) for n in ("unitigs", "color_sets", "metadata")))
    assert {r.kmer: list(r.colors) for r in again.kmers.collect()} == want


def test_bases_covered_and_kmers(spark):
    assert spark.range(1).select(kmers(F.lit("ACGT"), 5).alias("a"), kmers(F.lit("ACGTA"), 5).alias("b"), revcomp(F.lit("AACG")).alias("c")).first() == ([], ["ACGTA"], "CGTT")
    x = index.build(spark.createDataFrame([(0, "ACGTTGCAAC")], "color int, seq string"), 4)
    reads = spark.createDataFrame([(0, "r", "ACGTTGXACGTT")], "query_idx long, name string, seq string")
    assert [r.bases for r in align.bases_covered(x, reads).collect()] == [11]


def test_fasta_and_filter(spark, built, tmp_path):
    (tmp_path / "r.fa").write_text(">r1 first\nACGACATC\nTACTACTAG\n>r2\nacaac\n\n>r3 x\nGGGGGGG\n")
    rows = formats.read_fasta(spark, str(tmp_path / "r.fa")).orderBy("ordinal").collect()
    assert [(r.ordinal, r["name"], r.seq) for r in rows] == [(0, "r1", "ACGACATCTACTACTAG"), (1, "r2", "ACAAC"), (2, "r3", "GGGGGGG")]
    (tmp_path / "r.fq").write_text("@a b\nACGT\n+\nIIII\n@c\nGG\n+\nII\n")
    assert [(r["name"], r.seq, r.qual) for r in formats.read_fastq(spark, str(tmp_path / "r.fq")).orderBy("ordinal").collect()] == [("a", "ACGT", "IIII"), ("c", "GG", "II")]
    reads = spark.createDataFrame([(f"r{i}", "A") for i in range(1, 5)], "name string, seq string")
    records = spark.createDataFrame([(0, "r1", [0]), (1, "r2", [1]), (2, "r3", [2]), (3, "r4", [])], "query_idx long, name string, colors array<long>")
    assert sorted(r["name"] for r in align.filter_reads(reads, records, [0, 2]).collect()) == ["r1", "r3"]
    with pytest.raises(ValueError):
        align.filter_reads(reads, records.where("query_idx < 3"), [0])


def test_em_and_report(spark):
    classes = spark.createDataFrame([([0], 6), ([1], 2), ([0, 1], 8)], "colors array<int>, n long")
    theta = research.em(classes, rounds=200, tolerance=1e-9)
    assert abs(theta[0] - 0.75) < 1e-4 and abs(theta[1] - 0.25) < 1e-4
    rows = spark.createDataFrame([("a", [0]), ("b", [0, 1]), ("c", [])], "name string, colors array<long>")
    each, totals = align.report(rows, spark.createDataFrame([(0, "x"), (1, "y")], "color int, name string"))
    assert [tuple(r) for r in each.collect()] == [(0, "x", 2, 1), (1, "y", 1, 0)] and tuple(totals.first()) == (3, 2)
