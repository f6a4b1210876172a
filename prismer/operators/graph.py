"""The colored de Bruijn graph: nodes are k-mers of both strands, edges overlap by k-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismer.functions.seq import canonical, revcomp
from prismer.operators.index import Index
from prismer.plans.storage import stored


def _ends(nodes: DataFrame, k: int) -> DataFrame:
    """For each (k-1)-mer: how many nodes start with it and end with it, and the least of either."""
    starts = nodes.select(F.substring("kmer", 1, k - 1).alias("p"), F.col("kmer").alias("s"), F.lit(None).cast("string").alias("e"))
    ends = nodes.select(F.substring("kmer", 2, k - 1).alias("p"), F.lit(None).cast("string").alias("s"), F.col("kmer").alias("e"))
    return starts.unionByName(ends).groupBy("p").agg(F.count("s").alias("n_start"), F.count("e").alias("n_end"), F.min("s").alias("dst"), F.min("e").alias("src"))


def edges(nodes: DataFrame, k: int) -> DataFrame:
    """(src, dst, label): the label is the last base of dst."""
    a = nodes.select(F.col("kmer").alias("src"), F.substring("kmer", 2, k - 1).alias("p"))
    b = nodes.select(F.col("kmer").alias("dst"), F.substring("kmer", 1, k - 1).alias("p"))
    return a.join(b, "p").select("src", "dst", F.substring("dst", k, 1).alias("label"))


def degrees(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, indegree, outdegree)."""
    ends = _ends(nodes, k)
    left, right = ends.select(F.col("p").alias("p1"), F.col("n_end").alias("indegree")), ends.select(F.col("p").alias("p2"), F.col("n_start").alias("outdegree"))
    rows = nodes.select("kmer", F.substring("kmer", 1, k - 1).alias("p1"), F.substring("kmer", 2, k - 1).alias("p2"))
    return rows.join(left, "p1").join(right, "p2").select("kmer", "indegree", "outdegree")


def colex(nodes: DataFrame) -> DataFrame:
    """The nodes in the order of their k-mers read from the last base to the first."""
    return nodes.orderBy(F.reverse("kmer"))


def out_neighbors(nodes: DataFrame, k: int, kmer: str) -> DataFrame:
    """(label, kmer) of the nodes that follow one node."""
    return nodes.where(F.substring("kmer", 1, k - 1) == kmer[1:]).select(F.substring("kmer", k, 1).alias("label"), "kmer")


def in_neighbors(nodes: DataFrame, k: int, kmer: str) -> DataFrame:
    """The nodes that one node follows."""
    return nodes.where(F.substring("kmer", 2, k - 1) == kmer[:-1]).select("kmer")


def node(nodes: DataFrame, k: int, kmer: str) -> DataFrame:
    """The node of one k-mer, or no row."""
    if len(kmer) != k:
        raise ValueError(f"{kmer!r} is not of length {k}")
    return nodes.where(F.col("kmer") == kmer)


def is_first(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, first): whether a node starts a unitig, as its predecessor is not the only one or has another successor."""
    ends = _ends(nodes, k).select("p", ((F.col("n_start") != 1) | (F.col("n_end") != 1)).alias("first"))
    return nodes.select("kmer", F.substring("kmer", 1, k - 1).alias("p")).join(ends, "p").select("kmer", "first")


def places(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, head, place): each node's maximal non-branching path, named by its first node, and its place on it.

    A cyclic path starts at its least node. Pointers to earlier nodes double their reach each round,
    by one join, and only nodes that have not met their path's start take part.
    """
    links = _ends(nodes, k).where("n_start = 1 and n_end = 1").select(F.col("dst").alias("kmer"), F.col("src").alias("anc"))
    state = nodes.select("kmer").join(links, "kmer", "left").select("kmer", "anc", F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.least("kmer", "anc").alias("mn"))
    todo = stored(state)
    done = [todo.where("anc is null").select("kmer", F.col("kmer").alias("head"), F.lit(0).cast("long").alias("place"))]
    todo = stored(todo.where("anc is not null"))
    heads = done[0]
    before = None
    while True:
        at_head = todo.join(heads.select(F.col("kmer").alias("anc"), F.col("head"), F.col("place").alias("more")), "anc")
        met = stored(at_head.select("kmer", "head", (F.col("dist") + F.col("more")).alias("place")))
        rest = todo.join(met.select("kmer"), "kmer", "left_anti")
        step = todo.select(F.col("kmer").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("mn").alias("mn2"))
        rest = stored(rest.join(step, "anc").select("kmer", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("mn", "mn2").alias("mn")))
        done.append(met)
        heads = heads.unionByName(met)
        state = rest.agg(F.count("*"), F.bit_xor(F.xxhash64("kmer", "mn"))).first()
        if not state[0]:
            break
        if state == before:  # only cycles are left, and each node knows its cycle's least
            cyc = rest.select("kmer", F.col("mn").alias("head"))
            done.append(_around(cyc, links))
            break
        before, todo = state, rest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _around(cycles: DataFrame, links: DataFrame) -> DataFrame:
    """Places on cycles from their least node: they are opened before it, then walked by doubling."""
    opened = cycles.join(links, "kmer").select("kmer", "head", F.when(F.col("kmer") != F.col("head"), F.col("anc")).alias("anc"))
    state = stored(opened.select("kmer", "head", "anc", F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("dist")))
    while state.where("anc is not null").take(1):
        step = state.select(F.col("kmer").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"))
        state = stored(state.join(step, "anc", "left").select("kmer", "head", F.col("anc2").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist")))
    return state.select("kmer", "head", F.col("dist").alias("place"))


def unitigs(nodes: DataFrame, k: int, on: DataFrame | None = None) -> DataFrame:
    """(head, seq, n_kmers): the sequence of each maximal non-branching path, on both strands."""
    walk = on if on is not None else places(nodes, k)
    each = walk.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", F.substring("kmer", k, 1).alias("c")))).alias("w"), F.count("*").alias("n_kmers"))
    tail = F.array_join(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: x["c"]), "")
    return each.select("head", F.concat("head", tail).alias("seq"), "n_kmers")


def colored_unitigs(index: Index) -> DataFrame:
    """(head, run_no, seq, n_kmers, colors): unitigs cut where the color set changes, run by run."""
    nodes = index.both_strands()
    walk = places(nodes.select("kmer"), index.k).join(nodes, "kmer")
    order = Window.partitionBy("head").orderBy("place")
    cut = walk.withColumn("_new", (~F.col("colors").eqNullSafe(F.lag("colors").over(order))).cast("int")).withColumn("run_no", F.sum("_new").over(order) - 1)
    each = cut.groupBy("head", "run_no", "colors").agg(F.array_sort(F.collect_list(F.struct("place", "kmer"))).alias("w"))
    tail = F.array_join(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: F.substring(x["kmer"], index.k, 1)), "")
    return each.select("head", "run_no", F.concat(F.get("w", F.lit(0))["kmer"], tail).alias("seq"), F.size("w").alias("n_kmers"), "colors")


def canonical_unitigs(index: Index) -> DataFrame:
    """(seq, n_kmers, colors): colored unitigs that hold each k-mer or its reverse complement once, in their smaller orientation.

    Of a path and its reverse complement the one of the smaller head stays. A path that meets its own reverse
    complement is cut where a k-mer's partner stands earlier on it; a cycle begins at its least node.
    """
    k, nodes = index.k, index.both_strands()
    walk = places(nodes.select("kmer"), k).join(nodes, "kmer").withColumn("_c", canonical(F.col("kmer")))
    first = walk.groupBy("_c").agg(F.min(F.struct("head", "place")).alias("f")).select("_c", "f.head", "f.place")
    kept = walk.join(first, ["_c", "head", "place"])
    order = Window.partitionBy("head").orderBy("place")
    goes_on = F.col("colors").eqNullSafe(F.lag("colors").over(order)) & (F.col("place") - F.lag("place").over(order) == 1)
    cut = kept.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("run_no", F.sum("_new").over(order) - 1)
    each = cut.groupBy("head", "run_no", "colors").agg(F.array_sort(F.collect_list(F.struct("place", "kmer"))).alias("w"))
    tail = F.array_join(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x: F.substring(x["kmer"], k, 1)), "")
    seq = F.concat(F.get("w", F.lit(0))["kmer"], tail)
    return each.select(F.least(seq, revcomp(seq)).alias("seq"), F.size("w").alias("n_kmers"), "colors")


def gfa_links(unitig: DataFrame, k: int) -> DataFrame:
    """(a, a_strand, b, b_strand): overlaps of k-1 between oriented unitigs (unitig_id, seq); of a link and its reverse the smaller."""
    turned = unitig.select("unitig_id", F.lit("+").alias("strand"), "seq").unionByName(unitig.select("unitig_id", F.lit("-").alias("strand"), revcomp(F.col("seq")).alias("seq")))
    a = turned.select(F.col("unitig_id").alias("a"), F.col("strand").alias("a_strand"), F.substring("seq", -(k - 1), k - 1).alias("p"))
    b = turned.select(F.col("unitig_id").alias("b"), F.col("strand").alias("b_strand"), F.substring("seq", 1, k - 1).alias("p"))
    flip = lambda c: F.when(F.col(c) == "+", "-").otherwise("+")
    one, other = F.struct("a", "a_strand", "b", "b_strand"), F.struct(F.col("b").alias("a"), flip("b_strand").alias("a_strand"), F.col("a").alias("b"), flip("a_strand").alias("b_strand"))
    return a.join(b, "p").select(F.least(one, other).alias("l")).distinct().select("l.*")


def both_ways(links: DataFrame) -> DataFrame:
    """Each of gfa_links and its reverse; a link that is its own reverse once."""
    flip = lambda c: F.when(F.col(c) == "+", "-").otherwise("+")
    turned = links.select(F.col("b").alias("a"), flip("b_strand").alias("a_strand"), F.col("a").alias("b"), flip("a_strand").alias("b_strand"))
    return links.unionByName(turned).distinct()


def rotated(seq: Column, k: int) -> Column:
    """A cyclic path's sequence (its last k-1 bases are its first) begun at its least k-mer; any other as it is."""
    n = F.length(seq)
    cyclic = (n >= k) & (seq.substr(F.lit(1), F.lit(k - 1)) == seq.substr(n - k + 2, F.lit(k - 1)))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.struct(seq.substr(i, F.lit(k)).alias("s"), i.alias("i")))
    at = F.array_min(starts)["i"]
    return F.when(cyclic, F.concat(seq, seq.substr(F.lit(k), n)).substr(at, n)).otherwise(seq)
