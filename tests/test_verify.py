"""Voting minima, fits and likelihoods by brute force; checks of exports."""

import math

import pytest
from pyspark.sql import functions as F

from prismer import cli
from prismer.operators import graph, index, research, verify
from prismer.sources import formats
from tests.test_engine import READS, table


def test_support_minima(spark):
    rows = spark.createDataFrame([(0, 0, 4, 9, 10.0), (0, 1, 2, 9, 10.0), (1, 0, 1, 4, 10.0), (1, 1, 0, 5, 10.0), (2, 0, 0, 3, 0.0)], "query_idx int, color int, uniq int, shared int, den double")
    got = lambda x: sorted(map(tuple, x.collect()))
    assert got(research.vote(rows, 2, 5, 0.5)) == [(0, 0), (0, 1), (1, 1)]
    assert got(research.vote(rows, 2, 3, 0.5)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert got(research.weighted_support(rows, 0.0, 0.3)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert got(research.weighted_support(rows, 0.0, 0.3, least_unique=1, least_shared=5)) == [(0, 0), (0, 1)]


def test_fit_with_ratio(spark):
    rows = [([0], 6), ([1], 2), ([0, 1], 8), ([], 3), ([2], 1)]
    theta, w = [1 / 3] * 3, 10.0
    for _ in range(7):
        like = [[w if c in s else 1.0 for c in range(3)] for s, _ in rows]
        post = [[t * x / sum(map(math.prod, zip(theta, each))) for t, x in zip(theta, each)] for each in like]
        inside = sum(n * p for (s, n), each in zip(rows, post) for c, p in enumerate(each) if c in s)
        theta, w = [sum(n * each[c] for (_, n), each in zip(rows, post)) / 20 for c in range(3)], inside / (20 - inside)
    got, ratio = research.em_with_ratio(spark.createDataFrame(rows, "colors array<int>, n long"), 10.0, rounds=7, tolerance=0.0)
    assert ratio == pytest.approx(w) and [got[c] for c in range(3)] == pytest.approx(theta)
    sure = spark.createDataFrame([([0], 6), ([0, 1], 2)], "colors array<int>, n long")
    got, ratio = research.em_with_ratio(sure, 5.0, rounds=60)
    assert got[0] > 0.99 and (ratio is None or ratio > 1000)


def test_cluster_likelihoods(spark):
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def want(k, n):
        if k == 0 or n == k == 1:
            return 0.99 if k else 0.01
        phi = 0.35 + 0.01 / n
        a, b = 0.65 / phi, 0.35 / phi
        return 0.99 * math.exp(math.log(math.comb(n, k)) + beta(k + a, n - k + b) - beta(n + a, b))

    sizes = {0: 1, 1: 5, 2: 40}
    rows = [(q, c, min(n, k)) for q, k in enumerate((0, 1, 3, 17, 40)) for c, n in sizes.items()]
    hits, clusters = spark.createDataFrame(rows, "query_idx int, cluster int, hits int"), spark.createDataFrame(list(sizes.items()), "cluster int, size int")
    got = {(r.query_idx, r.cluster): r.likelihood for r in research.cluster_likelihoods(hits, clusters).collect()}
    assert got == pytest.approx({(q, c): want(k, sizes[c]) for q, c, k in rows})
    with pytest.raises(Exception, match="more hits"):
        research.cluster_likelihoods(spark.createDataFrame([(0, 1, 6)], hits.schema), clusters).collect()


def test_order_rotation_and_reverse(spark):
    nodes = spark.createDataFrame([(x,) for x in ("CCA", "ACC", "GAC", "TTA")], "kmer string")
    assert [r.kmer for r in graph.colex(nodes).collect()] == ["CCA", "TTA", "GAC", "ACC"]
    cases = {"ATCTATCGAAATCACACACTGATCT": "AAATCACACACTGATCTATCGAAAT", "CCAACGTT": "CCAACGTT", "ACGTA": "ACGTA", "ACG": "ACG", "": ""}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", graph.rotated(F.col("s"), 5).alias("r"))
    assert {r.s: r.r for r in rows.collect()} == cases
    both = formats.with_reverse(spark.createDataFrame([("x", "AACG")], "name string, seq string"))
    assert sorted(map(tuple, both.collect())) == [("x", "AACG"), ("x", "CGTT")]


def test_export_switches_and_checks(spark, tmp_path, capsys):
    d = tmp_path
    index.save(index.build(table(spark).select("color", "seq"), 5), f"{d}/index")
    # the same sequences, turned and in another order
    turned = index.build(formats.with_reverse(table(spark).select("color", "seq")).orderBy(F.desc("seq")), 5)
    index.save(turned, f"{d}/turned")
    fewer = [(c, s) for c, s in READS.values() if not s.startswith("CATCTTC")]
    index.save(index.build(spark.createDataFrame(fewer, "color int, seq string"), 5), f"{d}/fewer")
    for name in ("index", "turned", "fewer"):
        cli.main(["export", "-i", f"{d}/{name}", "-o", f"{d}/{name}.out"], spark)
    cli.main(["compare-dumps", f"{d}/index.out", f"{d}/turned.out"], spark)
    with pytest.raises(ValueError, match="n_kmers"):
        cli.main(["compare-dumps", f"{d}/index.out", f"{d}/fewer.out"], spark)
    cli.main(["export", "-i", f"{d}/index", "-o", f"{d}/g", "--gfa", "--no-color-sets"], spark)
    cli.main(["verify-gfa-links", f"{d}/g.unitigs.gfa", "-k", "5"], spark)
    assert not (d / "g.color_sets.txt").exists()
    lines = [r.value for r in spark.read.text(f"{d}/g.unitigs.gfa").collect()]
    links = [x for x in lines if x.startswith("L")]
    check = lambda x: sorted(map(tuple, verify.wrong_links(spark.createDataFrame([(v,) for v in x], "value string"), 5).collect()))
    a, s, b, t = links[0].split("\t")[1:5]
    assert check([x for x in lines if x != links[0]]) == [("missing", int(a[1:]), s, int(b[1:]), t)]
    seqs = {x.split("\t")[1]: x.split("\t")[2] for x in lines if x.startswith("S")}
    wrong = next(f"L\t{x}\t+\t{y}\t+\t4M" for x in seqs for y in seqs if seqs[x][-4:] != seqs[y][:4])
    assert [r[0] for r in check([*lines, wrong])] == ["false"]
    for bad in ("L\tu0\t+\tu0\t+\t3M", "S\tu999\tACG", lines[1], "L\tu0\tx\tu0\t+\t4M"):
        with pytest.raises(ValueError):
            check([*lines, bad])
    capsys.readouterr()
    cli.main(["export", "-i", f"{d}/index", "-o", f"{d}/n", "--no-unitigs", "--colors-to-stdout"], spark)
    assert capsys.readouterr().out.count("color_set_id=") == 5 and not (d / "n.unitigs.fa").exists()
    assert not [r for r in spark.read.text(f"{d}/n.metadata.txt").collect() if "num_unitigs" in r.value]
    cli.main(["stats", "-i", f"{d}/index"], spark)
    assert "n_unitigs\t127.0" in capsys.readouterr().out
