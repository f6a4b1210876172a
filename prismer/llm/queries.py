"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.llm import bpe_codec, fingerprints, line_dedup, near_vectors, ngram_join, packing, pii, token_counts, token_store, toxicity
from prismer.llm.common import shared_dir, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def secret_key(spark: SparkSession) -> str:
    """The key of surrogates: the session's spark.prismer.pii.key; the test tables hold no real people, so they need none."""
    return spark.conf.get("spark.prismer.pii.key", "test tables")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.prefix_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_store.digests(token_store.read(spark, path))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, short=True).select("doc_id", "n_lines", "n_dropped", "text")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_token_store, op3_packing, op4_ngram_join, op5_pii, op6_near_vectors, op7_toxicity, op8_fingerprints, op9_bpe_codec, op10_line_dedup)}


OP6_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)) > 0
), links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, seen) as (
  select vec_id, vec_id from embeddings union select r.node, l.b from reach r join links l on r.seen = l.a
), n as (select a, count(*) n from links group by a), c as (select node, min(seen) root from reach group by node)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) n_links, coalesce(c.root, e.vec_id) component_id, coalesce(c.root, e.vec_id) = e.vec_id kept
from embeddings e left join n on n.a = e.vec_id left join c on c.node = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_vectors": OP6_SQL}
