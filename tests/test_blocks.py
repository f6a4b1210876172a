"""Blocks of packed k-mers, and what is counted from them without a row for each k-mer."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismer.functions.seq import TEXT_CODES, dna, packed, turned, unpacked
from prismer.operators import align, blocks, graph, index, research


def texts(n, k, seed=1):
    rng = random.Random(seed)
    return [(i % 5, "".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.choice([0, k - 1, k, 60, 150])))) for i in range(n)]


def brute(rows, k):
    """k-mer of either strand to its rising colors."""
    out = {}
    for color, seq in rows:
        for w in (seq[i : i + k] for i in range(len(seq) - k + 1)):
            if "N" not in w:
                for x in (w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))):
                    out.setdefault(x, set()).add(color)
    return {w: sorted(c) for w, c in out.items()}


@pytest.mark.parametrize("k", [4, 9, 15, 31])
@pytest.mark.parametrize("most", [1, 70, 2**31 - 1])
def test_blocks_keep_every_pair(k, most, monkeypatch):
    monkeypatch.setattr(blocks, "GATHERED", 500)
    monkeypatch.setattr(blocks, "AT_ONCE", 64)
    rows = [(c * (most // 4), s) for c, s in texts(60, k)]
    rows += rows[:20]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["color", "seq"])
    made = pa.Table.from_batches([r for i in range(0, 80, 30) for r in blocks.pairs_of(k)(iter([batch.slice(i, 30)]))]).sort_by("part").to_batches(max_chunksize=37)
    got = {}

    def take(kmer, at, color):
        for i, w in enumerate(unpacked(kmer, k).to_pylist()):
            assert w not in got
            got[w] = color[at[i] : at[i + 1]].tolist()
        return iter(())

    list(blocks.folded(k, blocks.each(take))(iter(made)))
    turn = str.maketrans("ACGT", "TGCA")
    assert got == {w: c for w, c in brute(rows, k).items() if w <= w[::-1].translate(turn)}


def test_wanted_kmers_alone_are_shuffled(spark):
    k, rows = 9, texts(200, 9)
    table = spark.createDataFrame(rows, "color int, seq string")
    x = index.build(table, k)
    wanted = spark.createDataFrame([(w,) for w in [*sorted(brute(rows, k))[:40], "ANNNNNNNN", "AAAAAAAAA"]], "kmer string").select(F.least("kmer", F.translate(F.reverse("kmer"), "ACGT", "TGCA")).alias("kmer"))
    want = {r.kmer: list(r.colors) for r in x.kmers.join(wanted.distinct(), "kmer").collect()}
    assert {r.kmer: list(r.colors) for r in x.known(wanted).collect()} == want and want
    # the blocks that leave the tasks hold these pairs only
    few = np.sort(np.concatenate([blocks.scrambled(y, k) for _, y in packed(pa.array(sorted(want)), k)]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["color", "seq"])
    out = pa.Table.from_batches(list(blocks.pairs_of(k, wanted=few)(iter([batch]))))
    assert sum(len(b) for b in out["low"].to_pylist()) == 2 * sum(map(len, want.values()))
    # a read without a known k-mer, an index without one
    reads = spark.createDataFrame([(0, "NNNNNNNNNN"), (1, rows[3][1])], "query_idx long, seq string")
    same = index.Index(k, x.kmers, x.colors)
    assert sorted(map(str, align.hits(x, reads).collect())) == sorted(map(str, align.hits(same, reads).collect()))
    assert align.hits(index.build(table.limit(0), k), reads).where("colors is not null").count() == 0


def test_reads_go_over_the_sequences_once(spark, tmp_path, monkeypatch):
    def seen(batches):
        (tmp_path / str(len(list(tmp_path.iterdir())))).touch()
        yield from batches

    rows = texts(40, 9)
    reads = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows[::3])], "query_idx long, seq string")
    for most in (index.LOOKED_UP, 3):
        monkeypatch.setattr(index, "LOOKED_UP", most)
        before = len(list(tmp_path.iterdir()))
        table = spark.createDataFrame(rows, "color int, seq string").coalesce(1).mapInArrow(seen, "color int, seq string")
        x = index.build(table, 9, spark.createDataFrame([(c, str(c)) for c in range(5)], "color int, name string"))
        counts, totals = align.color_counts(x, reads)
        assert counts.count() and totals.count() and align.threshold(x, reads, 0.3, counted=(counts, totals)).count()
        assert len(list(tmp_path.iterdir())) == before + 1


def test_more_reads_than_are_looked_up(spark, monkeypatch):
    rows = texts(40, 9)
    x = index.build(spark.createDataFrame(rows, "color int, seq string"), 9)
    reads = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows[::3])], "query_idx long, seq string")
    want = sorted(map(str, align.color_counts(x, reads)[0].collect()))
    monkeypatch.setattr(index, "LOOKED_UP", 3)
    assert sorted(map(str, align.color_counts(x, reads)[0].collect())) == want and want


def test_text_codes_are_dna(spark):
    odd = ["", "Straße, Łódź. Ænima\nüber 12 \t x.Y", "NnNn", "日本語abc.def\r\nghi", "a" * 20, "A.C.G.T"]
    seqs = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(dna(F.col("t"))).collect()]
    for k in (1, 2, 3, 5):
        for most in (3, 1 << 18):
            by_text = [(r, w) for row, y in packed(pa.array(odd), k, most, TEXT_CODES) for r, w in zip(row.tolist(), unpacked(y, k).to_pylist())]
            by_dna = [(r, w) for row, y in packed(pa.array(seqs), k) for r, w in zip(row.tolist(), unpacked(y, k).to_pylist())]
            assert by_text == by_dna


def test_turned():
    kmers = ["ACGTTGCAAC", "AAAAAAAAAA", "ACGTTAACGT"]
    y = np.array([int("".join(str("ACGT".index(c)) for c in w), 4) for w in kmers], np.uint64)
    assert unpacked(turned(y, 10), 10).to_pylist() == [w[::-1].translate(str.maketrans("ACGT", "TGCA")) for w in kmers]


@pytest.mark.parametrize("k", [4, 9])
def test_set_sizes_by_parts(spark, k):
    # colors on both sides of what fits a mask
    rows = [(c * 30, s) for c, s in texts(80, k)]
    x = index.build(spark.createDataFrame(rows, "color int, seq string"), k)
    want = {}
    for c in brute(rows, k).values():
        want[tuple(c)] = want.get(tuple(c), 0) + 1
    got = x.set_sizes().collect()
    assert {tuple(r.colors): r.n_kmers for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("k", [2, 4, 5, 9])
def test_firsts_by_starts(spark, k):
    x = index.build(spark.createDataFrame(texts(60, k)[:: 8 if k < 9 else 1], "color int, seq string"), k)
    want = graph.is_first(x.both_strands(), k).where("first").count()
    assert index.n_first(x).first()[0] == want
    # an index without blocks, as a loaded one
    assert index.n_first(index.Index(k, x.kmers, x.colors)).first()[0] == want
    assert {r.metric: r.value for r in index.stats(x).collect()}["n_noncyclic_unitigs"] == want


def classes_by_hand(rows):
    """class_stats from (key, set)."""
    by_key, out = {}, {}
    for key, s in rows:
        by_key.setdefault(key, []).append(set(s))
    for key, sets in by_key.items():
        union = set().union(*sets)
        out.setdefault(len(key), []).append((len(sets), sum(s == union for s in sets), sum(len(s) / len(union) for s in sets) / len(sets)))
    return {n: (sum(g[1] for g in v), sum(g[0] for g in v), len(v), round(sum(g[2] for g in v) / len(v), 9)) for n, v in out.items()}


def stats_of(df):
    return {r.len: (r.correct, r.total, r.n, round(r.mean_jaccard, 9)) for r in df.collect()}


@pytest.mark.parametrize("k,m", [(4, 2), (9, 4), (9, 9), (31, 31)])
def test_minimizers_by_parts(spark, k, m):
    rows = texts(60, k)
    x = index.build(spark.createDataFrame(rows, "color int, seq string"), k)
    want = classes_by_hand((min(w[i : i + m] for i in range(k - m + 1)), c) for w, c in brute(rows, k).items())
    assert stats_of(research.minimizer_stats(x, m)) == want
    assert stats_of(research.minimizer_stats(index.Index(k, x.kmers, x.colors), m)) == want


@pytest.mark.parametrize("k", [4, 9, 31, 33])
def test_finimizers_are_not_sent_whole(spark, k):
    rows = texts(25, k)
    nodes = brute(rows, k)
    ends = {}
    for w in nodes:
        for i in range(1, k + 1):
            ends[w[-i:]] = ends.get(w[-i:], 0) + 1
    best = lambda w: min((len(s), s[::-1]) for e in range(1, k + 1) for s in (w[i:e] for i in range(e)) if ends.get(s) == 1)[1][::-1]
    got = research.finimizer_stats(index.build(spark.createDataFrame(rows, "color int, seq string"), k))
    assert stats_of(got) == classes_by_hand((best(w), c) for w, c in nodes.items())
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
