"""A corpus pipeline of five stages over documents, each written as Parquet and read again by the next.

Toxic documents go, repeated lines go, one document of each near-duplicate class stays, personal
data is replaced, and what is left is packed into token sequences.

For every stage: an empty table stays empty, all columns of documents stay as they are but for text and
n_chars, further ones too whatever their names, texts are read whole at any length, and nulls in other columns
than text change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismer.llm import line_dedup, ngram_join, packing, pii, toxicity
from prismer.llm.common import saved, table, unused
from prismer.llm.queries import secret_key, vocabulary


def apart(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """docs with its columns of these names, which an operator adds, renamed; and the columns that give the old names back."""
    new = {c: unused(docs, c)[0] for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half, by a classifier learnt from labels.

    Null and empty texts have the score of the classifier's bias; a score of exactly one half goes.
    Equal texts have equal scores, so repeated rows stay or go together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    docs, columns = apart(docs, "score")
    return toxicity.score(docs, model).where("score < 0.5").select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; those left without any text go, n_chars follows.

    Null and empty texts have no lines and stay as they are. Of equal and near lines the first by doc_id
    and place stays; rows of one doc_id and text share a result; lines under 20 characters are left alone.
    """
    docs, columns = apart(docs, "n_lines", "n_dropped")
    kept = line_dedup.dedup(docs).where("n_dropped = 0 or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each class of near-duplicates on five-word shingles.

    Texts without words, null ones too, are near to nothing and all stay. Texts of fewer words than five
    are their own shingle, so equal ones are copies. Repeated rows of one doc_id stay or go together, and
    rows with a null doc_id stay.
    """
    return ngram_join.one_of_each(docs, width=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by surrogates; n_chars follows.

    Null texts stay null, empty ones empty. An entity has one surrogate in all documents, so equal texts stay equal.
    """
    docs, columns = apart(docs, "n_entities")
    out = pii.replace(docs, secret_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048 ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are packed as their end id alone; repeated rows are packed each.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("PII", private), ("best-fit packing", packed)]

#: A learnt classifier and byte-pair encoding are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
