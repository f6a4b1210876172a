"""The command line from files to files, and the canonical export."""

import json

import pytest

from prismer import cli
from prismer.functions.seq import packed, unpacked
from prismer.operators import graph, index
from prismer.sources import formats
from tests.test_engine import INTERSECTION, READS, THRESHOLD

PAIR = str.maketrans("ACGT", "TGCA")


def flipped(x):
    return x[::-1].translate(PAIR)


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    for c in range(3):
        (d / f"C{c}.fna").write_text("".join(f">{n}\n{s}\n" for n, (x, s) in READS.items() if x == c))
    (d / "fof.txt").write_text("".join(f"{d}/C{c}.fna\n" for c in range(3)))
    (d / "reads.fa").write_text("".join(f">{n} more\n{s}\n" for n, (_, s) in READS.items()))
    cli.main(["build", "--file-colors", f"{d}/fof.txt", "-k", "5", "-o", f"{d}/index"], spark)
    return d


def aligned(spark, path):
    return {r["name"]: r["colors"] for r in map(json.loads, lines(spark, path))}


def test_build_align_report(spark, files):
    d = files
    cli.main(["intersection-pseudoalign", "-i", f"{d}/index", "-q", f"{d}/reads.fa", "-o", f"{d}/both"], spark)
    assert aligned(spark, d / "both") == INTERSECTION
    (d / "queries.txt").write_text(f"{d}/reads.fa\n{d}/C0.fna\n")
    (d / "outputs.txt").write_text(f"{d}/o1\n{d}/o2\n")
    cli.main(["threshold-pseudoalign", "-i", f"{d}/index", "--query-list", f"{d}/queries.txt", "--query-output-list", f"{d}/outputs.txt", "-d", "0.7", "-n", "all", "--report-hit-counts", "--report-bases-covered"], spark)
    assert aligned(spark, d / "o1") == THRESHOLD and aligned(spark, d / "o2") == {n: c for n, c in THRESHOLD.items() if n.startswith("C1")}
    first = json.loads(lines(spark, d / "o2")[0])
    assert first["kmer_hits"] == [21, 21] and first["bases_covered"] == [25, 25]
    cli.main(["report", "-i", f"{d}/index", "--input", f"{d}/o1", "-o", f"{d}/report"], spark)
    got = json.loads("\n".join(lines(spark, d / "report")))
    assert (got["n_reads"], got["n_positive_reads"], got["positive_by_color"][0][1]) == (7, 7, 6)
    cli.main(["dump-color-names", "-i", f"{d}/index", "-o", f"{d}/names"], spark)
    assert lines(spark, d / "names") == [f"{c}\t{d}/C{c}.fna" for c in range(3)]
    cli.main(["print-color-sets", "-i", f"{d}/index", "-q", f"{d}/C0.fna", "-p", "-o", f"{d}/sets"], spark)
    assert lines(spark, d / "sets")[0].startswith("ACGAC 0 1")
    with pytest.raises(ValueError):
        cli.main(["intersection-pseudoalign", "-i", f"{d}/index"], spark)
    (d / "one.txt").write_text(f"{d}/o3\n")
    with pytest.raises(ValueError):
        cli.main(["intersection-pseudoalign", "-i", f"{d}/index", "--query-list", f"{d}/queries.txt", "--query-output-list", f"{d}/one.txt"], spark)
    with pytest.raises(ValueError):
        cli.main(["build", "--file-colors", f"{d}/fof.txt", "-k", "4", "--from-unitigs", "-o", f"{d}/even"], spark)


def test_pieces_merge_export_import(spark, files):
    d = files
    want = {r.kmer: list(r.colors) for r in index.load(spark, f"{d}/index").kmers.collect()}
    cli.main(["build", "--file-colors", f"{d}/fof.txt", "-k", "5", "-o", f"{d}/piece", "--to-disk-in-pieces", "2"], spark)
    (d / "pieces.txt").write_text(f"{d}/piece.0\n{d}/piece.1\n")
    cli.main(["merge", "--index-file-list", f"{d}/pieces.txt", "-o", f"{d}/merged"], spark)
    merged = index.load(spark, f"{d}/merged")
    assert {r.kmer: list(r.colors) for r in merged.kmers.collect()} == want and merged.n_colors == 3
    cli.main(["export", "-i", f"{d}/index", "-o", f"{d}/dump"], spark)
    cli.main(["export", "-i", f"{d}/index", "-o", f"{d}/gfa", "--gfa"], spark)
    assert lines(spark, d / "gfa.unitigs.gfa")[0] == "H\tVN:Z:1.0"
    cli.main(["import", "-c", f"{d}/dump", "-o", f"{d}/again"], spark)
    assert {r.kmer: list(r.colors) for r in index.load(spark, f"{d}/again").kmers.collect()} == want
    (d / "kmers.fa").write_text(">a\nACGTA\n>b\nCCCCC\n")
    cli.main(["import-sbwt", "-s", f"{d}/kmers.fa", "--color-name", "mine", "-o", f"{d}/mine"], spark)
    assert [tuple(r) for r in index.load_names(spark, f"{d}/mine").collect()] == [(0, "mine")]


def test_filter_reads_to_files(spark, files, capsys):
    d = files
    (d / "r.fq").write_text("".join(f"@r{i}\nACGT\n+\nIII{i}\n" for i in (1, 2, 3, 4, 1)))
    (d / "r.jsonl").write_text("".join(json.dumps({"name": f"r{i}", "colors": c}) + "\n" for i, c in ((1, [0]), (2, [1]), (3, [2]), (4, []))))
    (d / "t.txt").write_text("0\n\n2\n")
    cli.main(["filter-reads", "--reads", f"{d}/r.fq", "--pseudoalignment", f"{d}/r.jsonl", "--colors", f"{d}/t.txt", "-o", f"{d}/kept.fastq.gz"], spark)
    assert lines(spark, d / "kept.fastq.gz") == [x for i in (1, 3, 1) for x in (f"@r{i}", "ACGT", "+", f"III{i}")] and "r1" in capsys.readouterr().err
    (d / "bad.txt").write_text("-1\n")
    with pytest.raises(ValueError):
        formats.read_color_list(spark, f"{d}/bad.txt")


@pytest.mark.parametrize("k, seqs", [(5, ["AACGTT"]), (4, ["AACCGAACCGAACCG", "AACCG"]), (5, [s for _, s in READS.values()]), (3, ["ACACACAC", "GTGT"])])
def test_canonical_export(spark, k, seqs):
    """Every k-mer or its partner once, and the links of a brute-force comparison."""
    import pyarrow as pa

    x = index.build(spark.createDataFrame(list(enumerate(seqs)), "color int, seq string"), k)
    want = {min(s[i : i + k], flipped(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1)}
    assert {z for _, y in packed(pa.array(seqs), k) for z in unpacked(y, k).to_pylist()} == want
    units = graph.canonical_unitigs(x).collect()
    got = [min(u.seq[i : i + k], flipped(u.seq[i : i + k])) for u in units for i in range(len(u.seq) - k + 1)]
    assert sorted(got) == sorted(want) and sum(u.n_kmers for u in units) == len(want)
    links = set()
    sides = [(u.seq, s, t) for u in units for s, t in (("+", u.seq), ("-", flipped(u.seq)))]
    turn = {"+": "-", "-": "+"}
    for a, s, t in sides:
        for b, r, v in sides:
            if t[-(k - 1) :] == v[: k - 1]:
                links.add(min((a, s, b, r), (b, turn[r], a, turn[s])))
    rows = graph.gfa_links(graph.canonical_unitigs(x).selectExpr("seq as unitig_id", "seq"), k)
    assert {tuple(r) for r in rows.collect()} == links
