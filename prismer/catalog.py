"""Queries of the k-mer engine over the driver's tables, and their SQL.

The tables hold no sequences, so texts are turned into them letter by letter (functions.seq.dna).
Documents are the references, with the number of their source as color; benchmark items are the
reads. Graph queries take the benchmark items as references, each with its own color. All queries
read whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.functions.seq import BASES, LETTERS, TEXT_CODES, dna, revcomp
from prismer.operators import align, graph, index, research
from prismer.operators.index import Index
from prismer.plans.storage import stored
from prismer.sources import formats

K, M = 15, 7
#: Short enough that paths of the benchmark items branch.
GRAPH_K = 9


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are: the index reads them by TEXT_CODES, which stand for functions.seq.dna."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.where("text is not null").select(F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("color"), F.col("text").alias("seq"), "doc_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.where("text is not null").select("item_id", F.concat(F.lit("item"), "item_id").alias("name"), dna(F.col("text")).alias("seq"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("source").distinct()
    return rows.select(F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("color"), F.col("source").alias("name"))


def built(spark: SparkSession, sf_dir: str) -> Index:
    return index.build(documents(spark, sf_dir).select("color", "seq"), K, sources(spark, sf_dir), TEXT_CODES)


def item_index(spark: SparkSession, sf_dir: str, k: int = K) -> Index:
    rows = items(spark, sf_dir)
    return index.build(rows.select(F.col("item_id").cast("int").alias("color"), "seq"), k, rows.select(F.col("item_id").cast("int").alias("color"), "name"))


def joined(c: str = "colors"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def kmer_index(spark, sf_dir):
    return built(spark, sf_dir).both_strands().select("kmer", F.size("colors").cast("long").alias("n_colors"), joined().alias("colors"))


def color_set_sizes(spark, sf_dir):
    rows = built(spark, sf_dir).set_sizes()
    return rows.select(joined().alias("colors"), F.size("colors").cast("long").alias("size"), "n_kmers")


def _threshold(denominator):
    def query(spark, sf_dir):
        return align.threshold(built(spark, sf_dir), items(spark, sf_dir), 0.7, denominator, key="item_id")

    return query


def intersection(spark, sf_dir):
    return align.intersection(built(spark, sf_dir), items(spark, sf_dir), min_hits=2, key="item_id")


def kmer_hits(spark, sf_dir):
    return align.color_counts(built(spark, sf_dir), items(spark, sf_dir), "item_id")[0]


def bases_covered(spark, sf_dir):
    return align.bases_covered(built(spark, sf_dir), items(spark, sf_dir), "item_id")


def print_color_sets(spark, sf_dir):
    return formats.color_set_lines(align.hits(built(spark, sf_dir), items(spark, sf_dir), "item_id"), True, "item_id")


def _records(spark, sf_dir, x=None):
    x = x or built(spark, sf_dir)
    rows = items(spark, sf_dir)
    counted = tuple(map(stored, align.color_counts(x, rows, "item_id")))
    return align.records(rows, align.threshold(x, rows, 0.3, key="item_id", counted=counted), {"kmer_hits": counted[0]}, "item_id")


def report(spark, sf_dir):
    return align.report(_records(spark, sf_dir), sources(spark, sf_dir))[0]


def report_totals(spark, sf_dir):
    return align.report(_records(spark, sf_dir), sources(spark, sf_dir))[1]


def alignment_lines(spark, sf_dir):
    return formats.plain_lines(_records(spark, sf_dir).drop("kmer_hits"), key="item_id")


def alignment_json(spark, sf_dir):
    return formats.json_lines(_records(spark, sf_dir), positive_only=True, key="item_id")


def filter_reads(spark, sf_dir):
    rows = stored(_records(spark, sf_dir).withColumn("query_idx", F.col("item_id")))
    return align.filter_reads(items(spark, sf_dir), rows, [0, 3, 7]).select("item_id")


def merge_union(spark, sf_dir):
    docs = documents(spark, sf_dir).select("color", "seq")
    names = sources(spark, sf_dir)
    low = index.build(docs.where("color < 10"), K, names.where("color < 10"), TEXT_CODES)
    high = index.build(docs.where("color >= 10").withColumn("color", F.col("color") - 10), K, names.where("color >= 10").withColumn("color", F.col("color") - 10), TEXT_CODES)
    return index.merge([low, high]).both_strands().select("kmer", joined().alias("colors"))


def index_stats(spark, sf_dir):
    return index.stats(built(spark, sf_dir))


def sparse_dense(spark, sf_dir):
    x = built(spark, sf_dir)
    kind = F.when(index.is_dense(F.size("colors"), x.n_colors), "dense").otherwise("sparse")
    return x.set_sizes().groupBy(kind.alias("encoding")).agg(F.count("*").alias("n_sets"))


def minimizer_stats(spark, sf_dir):
    return research.minimizer_stats(built(spark, sf_dir), M)


def finimizer_stats(spark, sf_dir):
    return research.finimizer_stats(item_index(spark, sf_dir))


def kmer_checksum(spark, sf_dir):
    rows = built(spark, sf_dir).both_strands()
    return research.checksum(rows, F.concat("kmer", F.lit(" "), joined()))


def color_names(spark, sf_dir):
    return sources(spark, sf_dir)


def dbg_edges(spark, sf_dir):
    return graph.edges(item_index(spark, sf_dir).both_strands(), K)


def dbg_degrees(spark, sf_dir):
    return graph.degrees(item_index(spark, sf_dir).both_strands(), K)


def unitigs(spark, sf_dir):
    rows = graph.unitigs(item_index(spark, sf_dir).both_strands(), K)
    return rows.select(F.least("seq", revcomp(F.col("seq"))).alias("seq"), "n_kmers").distinct()


def colored_unitigs(spark, sf_dir):
    return graph.canonical_unitigs(item_index(spark, sf_dir, GRAPH_K)).select("seq", F.col("n_kmers").cast("long").alias("n_kmers"), joined().alias("colors"))


def gfa_links(spark, sf_dir):
    rows = graph.canonical_unitigs(item_index(spark, sf_dir, GRAPH_K)).select(F.col("seq").alias("unitig_id"), "seq")
    return graph.gfa_links(rows, GRAPH_K)


def votes(spark, sf_dir):
    return research.vote(_support(spark, sf_dir), 3, 5, 0.5, "item_id")


def _support(spark, sf_dir):
    found = align.hits(built(spark, sf_dir), items(spark, sf_dir), "item_id").where("colors is not null")
    return research.consensus_counts(found, "item_id")


def weighted_support(spark, sf_dir):
    counts = _support(spark, sf_dir)
    den = counts.groupBy("item_id").agg(F.max("shared").alias("den"))
    return research.weighted_support(counts.join(den, "item_id"), 0.3, 0.5, "item_id", least_unique=1, least_shared=3)


def em_theta(spark, sf_dir):
    rows = _records(spark, sf_dir).groupBy("colors").agg(F.count("*").alias("n"))
    theta = research.em(rows, rounds=50, tolerance=0.0)
    return spark.createDataFrame([(int(c), round(t, 6)) for c, t in theta.items()], "color int, theta double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        kmer_index, color_set_sizes, intersection, kmer_hits, bases_covered, print_color_sets, report, report_totals, alignment_lines, alignment_json, filter_reads, merge_union,
        index_stats, sparse_dense, minimizer_stats, finimizer_stats, kmer_checksum, color_names, dbg_edges, dbg_degrees, unitigs, colored_unitigs, gfa_links, votes, weighted_support, em_theta,
    )
    return {f"threshold_{d.replace('-', '')}": _threshold(d) for d in ("all", "relevant", "max-hits")} | {f.__name__: f for f in plain}


def _sql() -> dict[str, str]:
    seq = f"regexp_replace(regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[.\\n]', 'N', 'g'), '[^ACGTN]', '', 'g')"
    rc = "translate(reverse(kmer), 'ACGT', 'TGCA')"

    def idx(name: str, color: str, rows: str, K: int = K) -> str:
        return f"""
        {name}_seq as (select {color} color, {seq} seq from {rows} where text is not null),
        {name}_fw as (select distinct color, substr(seq, i, {K}) kmer from (select color, seq, unnest(generate_series(1, length(seq) - {K - 1})) i from {name}_seq where length(seq) >= {K})),
        {name}_kc as (select color, kmer from {name}_fw where regexp_full_match(kmer, '[ACGT]+') union select color, {rc} from {name}_fw where regexp_full_match(kmer, '[ACGT]+')),
        {name}_idx as (select kmer, list_sort(list(color)) colors from {name}_kc group by kmer)"""

    doc = idx("d", "cast(regexp_extract(source, '([0-9]+)$', 1) as integer)", "documents")
    own = idx("b", "cast(item_id as integer)", "benchmark")
    reads = f"""
        q as (select item_id, {seq} seq from benchmark where text is not null),
        p as (select item_id, i - 1 pos, substr(seq, i, {K}) kmer from (select item_id, seq, unnest(generate_series(1, length(seq) - {K - 1})) i from q where length(seq) >= {K})),
        h as (select p.item_id, p.pos, p.kmer, x.colors from p left join d_idx x on p.kmer = x.kmer),
        t as (select item_id, count(*) n_all, count(colors) n_rel from h group by item_id),
        e as (select item_id, pos, unnest(colors) color, len(colors) w from h where colors is not null),
        n as (select item_id, color, count(*) hits from e group by all)"""
    names = "names as (select distinct cast(regexp_extract(source, '([0-9]+)$', 1) as integer) color, source name from documents where text is not null)"
    aligned = "a as (select n.item_id, n.color, n.hits from n join t using (item_id) where n.hits / cast(n_all as double) >= 0.3)"
    per_read = "r as (select q.item_id, coalesce(list(a.color order by a.color) filter (a.color is not null), []) colors, coalesce(list(a.hits order by a.color) filter (a.color is not null), []) hits from q left join a using (item_id) group by q.item_id)"
    text = "array_to_string(colors, ',')"
    d, dr = f"with {doc}", f"with {doc}, {reads}"
    dra = f"{dr}, {aligned}, {per_read}, {names}"

    def threshold(den: str) -> str:
        return f"{dr}, m as (select *, max(hits) over (partition by item_id) most from n join t using (item_id)) select item_id, color, hits, n_all, n_rel from m where n_rel >= 1 and hits / cast({den} as double) >= 0.7"

    def classes(key: str, name: str) -> str:
        return f"""
        c as (select {key} key, colors from {name}_idx), u as (select key, list_sort(list_distinct(flatten(list(colors)))) uni from c group by key),
        s as (select c.key, count(*) size, count(*) filter (colors = uni) correct, avg(len(colors) / cast(len(uni) as double)) jaccard from c join u using (key) group by c.key)
        select cast(length(key) as integer) len, sum(correct) / cast(sum(size) as double) frac, cast(sum(correct) as bigint) correct, cast(sum(size) as bigint) total, avg(size) mean_class_size, avg(jaccard) mean_jaccard, count(*) n from s group by length(key)"""

    width = "20"
    ends = f"""
        f as (select kmer, substr(kmer, 1, {K - 1}) p, substr(kmer, 2) s from {{0}}_idx),
        np as (select p, count(*) n from f group by p), ns as (select s, count(*) n from f group by s)"""
    first = "(coalesce(ns.n, 0) <> 1 or coalesce(np.n, 0) <> 1)"
    support = "w as (select item_id, color, count(*) filter (w = 1) uniq, count(*) shared from e group by all)"
    walk = f"""
        heads as (select f.kmer from f left join ns on f.p = ns.s left join np on f.p = np.p where {first}),
        nxt as (select f.kmer, g.kmer nk from f join f g on g.p = f.s join np on np.p = f.s join ns on ns.s = f.s where np.n = 1 and ns.n = 1),
        walk(head, kmer, seq, n) as (select kmer, kmer, kmer, 1 from heads union all select w.head, x.nk, w.seq || right(x.nk, 1), w.n + 1 from walk w join nxt x on w.kmer = x.kmer),
        uni as (select head, max_by(seq, n) seq, max(n) n_kmers from walk group by head)"""
    g = GRAPH_K
    flip = lambda x: f"translate(reverse({x}), 'ACGT', 'TGCA')"
    # paths from their first nodes; cycles, which have none, from their least
    paths = f"""with recursive {idx("b", "cast(item_id as integer)", "benchmark", g)},
        f as (select kmer, substr(kmer, 1, {g - 1}) p, substr(kmer, 2) s from b_idx), np as (select p, count(*) n from f group by p), ns as (select s, count(*) n from f group by s),
        nxt as (select a.kmer, b.kmer nk from f a join f b on b.p = a.s join np on np.p = a.s join ns on ns.s = a.s where np.n = 1 and ns.n = 1),
        walk(head, kmer, place) as (select kmer, kmer, 0 from f where kmer not in (select nk from nxt) union all select w.head, x.nk, w.place + 1 from walk w join nxt x on w.kmer = x.kmer),
        rest as (select kmer from f where kmer not in (select kmer from walk)),
        around(head, kmer, place) as (select kmer, kmer, 0 from rest union all select w.head, x.nk, w.place + 1 from around w join nxt x on w.kmer = x.kmer where x.nk <> w.head),
        least as (select head from around group by head having min(kmer) = head),
        every as (select * from walk union all select * from around where head in (select head from least)),
        once as (select e.*, i.colors from every e join b_idx i using (kmer) qualify row_number() over (partition by least(e.kmer, {flip("e.kmer")}) order by e.head, e.place) = 1),
        marked as (select *, case when colors = lag(colors) over w and place = lag(place) over w + 1 then 0 else 1 end fresh from once window w as (partition by head order by place)),
        runs as (select *, sum(fresh) over (partition by head order by place) run from marked),
        units as (select min_by(kmer, place) || coalesce(string_agg(right(kmer, 1), '' order by place) filter (fresh = 0), '') s, count(*) n_kmers, any_value(colors) colors from runs group by head, run),
        u as (select least(s, {flip("s")}) seq, n_kmers, colors from units)"""
    links = f"""{paths}, o as (select seq id, '+' st, seq t from u union all select seq, '-', {flip("seq")} from u),
        l as (select a.id a, a.st a_strand, b.id b, b.st b_strand from o a join o b on right(a.t, {g - 1}) = left(b.t, {g - 1})),
        z as (select least(row(a, a_strand, b, b_strand), row(b, case b_strand when '+' then '-' else '+' end, a, case a_strand when '+' then '-' else '+' end)) r from l)
        select distinct struct_extract(r, 1) a, struct_extract(r, 2) a_strand, struct_extract(r, 3) b, struct_extract(r, 4) b_strand from z"""
    finimizers = f"""with {own}, ends as (select right(kmer, n) s from (select kmer, unnest(range(1, {K + 1})) n from b_idx) group by 1 having count(*) = 1),
        inner_ as (select distinct kmer, colors, substr(kmer, e - n + 1, n) s from (select kmer, colors, e, unnest(range(1, e + 1)) n from (select kmer, colors, unnest(range(1, {K + 1})) e from b_idx))),
        c as (select colors, reverse(min({{'l': length(s), 'r': reverse(s)}}).r) key from inner_ join ends using (s) group by kmer, colors),
        u as (select key, list_sort(list_distinct(flatten(list(colors)))) uni from c group by key),
        s as (select c.key, count(*) size, count(*) filter (colors = uni) correct, avg(len(colors) / cast(len(uni) as double)) jaccard from c join u using (key) group by c.key)
        select cast(length(key) as integer) len, sum(correct) / cast(sum(size) as double) frac, cast(sum(correct) as bigint) correct, cast(sum(size) as bigint) total, avg(size) mean_class_size, avg(jaccard) mean_jaccard, count(*) n from s group by length(key)"""
    mixture = f"""{dra.replace("with ", "with recursive ", 1)}, cl as (select colors, cast(count(*) as double) n from r where len(colors) > 0 group by colors),
        x as (select row_number() over () cls, colors, n from cl), y as (select cls, n, unnest(colors) color from x), total as (select sum(n) n from x),
        theta(step, color, w) as (select 0, color, 1 / cast(count(*) over () as double) from (select distinct color from y)
          union all select step + 1, color, sum(share) / any_value(total.n) from (select step, y.color, y.n * w / sum(w) over (partition by y.cls) share from theta join y using (color)) v, total where step < 50 group by step, color)
        select color, round(w, 6) theta from theta where step = 50"""
    return {
        "colored_unitigs": f"{paths} select seq, n_kmers, {text} colors from u",
        "gfa_links": links,
        "finimizer_stats": finimizers,
        "em_theta": mixture,
        "threshold_all": threshold("n_all"),
        "threshold_relevant": threshold("n_rel"),
        "threshold_maxhits": threshold("most"),
        "kmer_index": f"{d} select kmer, len(colors) n_colors, {text} colors from d_idx",
        "color_set_sizes": f"{d} select {text} colors, cast(len(colors) as bigint) size, count(*) n_kmers from d_idx group by colors",
        "intersection": f"""{dr}, g as (select item_id, count(*) runs from (select *, lag(colors) over (partition by item_id order by pos) before, row_number() over (partition by item_id order by pos) rn from h)
            where colors is not null and (rn = 1 or colors is distinct from before) group by item_id)
            select n.item_id, n.color from n join t using (item_id) join g using (item_id) where n.hits = t.n_rel and g.runs >= 2""",
        "kmer_hits": f"{dr} select item_id, color, hits from n",
        "bases_covered": f"{dr} select item_id, color, cast(sum(least({K}, coalesce(pos - before, {K}))) as bigint) bases from (select *, lag(pos) over (partition by item_id, color order by pos) before from e) group by all",
        "print_color_sets": f"{dr} select item_id, cast(pos as integer) pos, kmer || ' ' || coalesce(array_to_string(colors, ' '), '') as value from h",
        "report": f"{dra}, x as (select unnest(colors) color, len(colors) w from r) select x.color, names.name, count(*) positive, count(*) filter (w = 1) unique_positive from x join names on x.color = names.color group by all",
        "report_totals": f"{dra} select count(*) n_reads, count(*) filter (len(colors) > 0) n_positive_reads from r",
        "alignment_lines": f"{dra} select case when len(colors) = 0 then cast(item_id as varchar) else item_id || ' ' || array_to_string(colors, ' ') end as value from r",
        "alignment_json": f"""{dra} select '{{"name":"item' || item_id || '","colors":[' || array_to_string(colors, ',') || '],"kmer_hits":[' || array_to_string(hits, ',') || ']}}' as value from r where len(colors) > 0""",
        "filter_reads": f"{dra} select item_id from r where list_has_any(colors, [0, 3, 7])",
        "merge_union": f"{d} select kmer, {text} colors from d_idx",
        "index_stats": f"""{d}, {ends.format("d")}, s as (select colors, len(colors) size, count(*) n from d_idx group by colors), z as (select count(*) n from (select distinct source from documents where text is not null)),
            v as (select sum(s.n) n_kmers, max(z.n) n_colors, count(*) n_color_sets, count(*) filter (z.n <= size * 5 + 64) n_dense_sets, count(*) filter (z.n > size * 5 + 64) n_sparse_sets, avg(size) m1, sum(size * s.n) / cast(sum(s.n) as double) m2 from s, z),
            o as (select count(*) n from f left join ns on f.p = ns.s left join np on f.p = np.p where {first})
            select unnest(['n_kmers', 'n_colors', 'n_color_sets', 'n_dense_sets', 'n_sparse_sets', 'mean_distinct_set_size', 'mean_set_size_per_kmer', 'n_noncyclic_unitigs']) metric,
                   unnest([cast(n_kmers as double), n_colors, n_color_sets, n_dense_sets, n_sparse_sets, m1, m2, o.n]) as value from v, o""",
        "sparse_dense": f"{d} select case when {width} <= len(colors) * 5 + 64 then 'dense' else 'sparse' end as encoding, count(*) n_sets from (select distinct colors from d_idx) group by 1",
        "minimizer_stats": f"{d}, {classes(f'list_min([substr(kmer, i, {M}) for i in range(1, {K - M + 2})])', 'd')}",
        "kmer_checksum": f"{d}, v as (select sha1(kmer || ' ' || {text}) x from d_idx) select count(*) n, bit_xor(cast('0x' || substr(x, 1, 15) as bigint)) c0, bit_xor(cast('0x' || substr(x, 16, 15) as bigint)) c1, bit_xor(cast('0x' || substr(x, 31) as bigint)) c2 from v",
        "color_names": f"with {names} select * from names",
        "dbg_edges": f"with {own}, {ends.format('b')} select a.kmer src, b.kmer dst, right(b.kmer, 1) as label from f a join f b on a.s = b.p",
        "dbg_degrees": f"with {own}, {ends.format('b')} select f.kmer, coalesce(ns.n, 0) indegree, coalesce(np.n, 0) outdegree from f left join ns on f.p = ns.s left join np on f.s = np.p",
        "unitigs": f"with recursive {own}, {ends.format('b')}, {walk} select distinct least(seq, translate(reverse(seq), 'ACGT', 'TGCA')) seq, cast(n_kmers as bigint) n_kmers from uni",
        "votes": f"""{dr}, {support}, m as (select *, greatest(3, floor(max(uniq) over (partition by item_id) * 0.5)) nu, greatest(5, floor(max(shared) over (partition by item_id) * 0.5)) nh from w),
            k as (select *, bool_or(uniq >= nu) over (partition by item_id) sure from m) select item_id, color from k where case when sure then uniq >= nu else shared >= nh end""",
        "weighted_support": f"{dr}, {support} select item_id, color from w qualify uniq >= 1 and shared >= 3 and (uniq * 0.3e0 + shared * 0.7e0) / max(shared) over (partition by item_id) >= 0.5e0 - 1e-8",
    }


def oracle_sql() -> dict[str, str]:
    return _sql()
