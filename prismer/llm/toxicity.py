"""Counterfactual-regularised toxicity classifier over the presence of words and word beginnings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismer.llm.common import dropped, modest, parts, saved

#: Identity terms by kind and language; a counterfactual puts each term's successor in its place.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("deaf", "blind", "disabled"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: ts[(i + 1) % len(ts)] for ts in IDENTITY for i, t in enumerate(ts)}
SWAPPED = re.compile(r"(?<!\w)(" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
#: What is stripped from both ends of a word.
EDGES = "".join(map(chr, [*range(33, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»„“”‘’…–—"


@dataclass
class Model:
    """A weight for each trait and a bias; the score is the logistic of the present traits' sum."""

    words: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, present: Iterable[np.ndarray]) -> list[float]:
        return [float(1 / (1 + np.exp(-(self.bias + self.weights[i].sum())))) for i in present]


def distinct_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (lower case, marks stripped) of the column, and pairs row, word without repeats."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column, "")))
    found = lists.flatten().dictionary_encode()
    bare = pc.utf8_trim(found.dictionary, EDGES).dictionary_encode()
    word = bare.indices.to_numpy()[found.indices.to_numpy()] if len(found.dictionary) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    key = np.unique(row.astype(np.int64) * max(1, len(bare.dictionary)) + word)
    return bare.dictionary, key // max(1, len(bare.dictionary)), key % max(1, len(bare.dictionary))


def traits(word: str) -> list[str]:
    """The word and its beginnings of three to seven letters, which inflected forms share."""
    return [word, *(word[:k] + "*" for k in range(3, 1 + min(7, len(word) - 1)))]


def spread(row: np.ndarray, word: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs row, trait without repeats, from pairs row, word and each word's traits."""
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    if not len(flat) or not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = size[word]
    ends = np.cumsum(n)
    at = (np.cumsum(size) - size)[word]
    wide = int(flat.max()) + 1
    key = np.unique(np.repeat(row, n) * wide + flat[np.repeat(at - (ends - n), n) + np.arange(n.sum())])
    return key // wide, key % wide


def present(column: pa.Array, index: dict[str, int]) -> Iterator[np.ndarray]:
    """For each text the model's traits in it, as indexes."""
    for batch in parts(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 1_000_000, 0):
        part = batch.column(0)
        names, row, word = distinct_words(part)
        row, hit = spread(row, word, [[i for t in traits(w) if (i := index.get(t)) is not None] for w in names.to_pylist()])
        yield from np.split(hit, np.searchsorted(row, np.arange(1, len(part)))) if len(part) else ()


def counterfactual(text: str) -> str:
    """The text with every identity term replaced by the next of its kind."""
    return SWAPPED.sub(lambda m: SWAP.get(m[0].lower(), m[0]), text)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 1024, penalty: float = 1.0, ridge: float = 2e-4, held_out: bool = True) -> Model:
    """Fit on at most `sample` labelled documents, those of the smallest hashes of doc_id.

    With held_out, rows whose crc32 of doc_id as text is divisible by five are never used. Words and word
    beginnings are chosen by their likelihood ratio with the label among the sample's documents, at most `features`
    of them; the loss adds penalty * (score - counterfactual score)^2, on the linear scale, for
    documents that name an identity term. Only the sample's chosen words reach the driver. Rows with a null id, text
    or label are left out; without any labelled row of both kinds every score is the base rate.
    """
    modest(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = saved(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("toxic", "text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1_000_000):
            toxic = part.column(0).to_numpy()
            names, row, word = distinct_words(part.column(1))
            seen: dict[str, int] = {}
            row, trait = spread(row, word, [[seen.setdefault(t, len(seen)) for t in traits(w)] for w in names.to_pylist()])
            n = len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(np.bincount(trait, minlength=n)), pa.array(np.bincount(trait, toxic[row], minlength=n).astype(np.int64))], ["word", "n", "bad"])

    sizes = rows.agg(F.count("*"), F.sum("toxic")).first()
    total, bad = sizes[0] or 0, sizes[1] or 0
    base = np.log((bad + 0.5) / (total - bad + 0.5))
    if not 0 < bad < total:
        dropped(rows)
        return Model([], np.zeros(0), float(base))
    counts = rows.mapInArrow(words, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n >= 3 and word not in ('', '*')")

    def term(part, whole_part, whole):
        return F.when(part > 0, part * F.log(part * F.lit(float(total)) / (whole_part * F.lit(float(whole))))).otherwise(0.0)

    n, b = F.col("n"), F.col("bad")
    ratio = 2 * (term(b, n, bad) + term(n - b, n, total - bad) + term(bad - b, total - n, bad) + term(total - n - (bad - b), total - n, total - bad))
    names = [r[0] for r in counts.select("word", ratio.alias("g")).where("g > 10.8").orderBy(F.desc("g"), "word").limit(features).collect()]
    index = {w: i for i, w in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            other = pa.array([counterfactual(x) if SWAPPED.search(x) else None for x in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in present(texts, index)], pa.list_(pa.int32())), pa.array([x.tolist() if o else None for x, o in zip(present(other, index), other.is_valid().to_pylist())], pa.list_(pa.int32()))], ["toxic", "x", "other"])

    table = rows.mapInArrow(encode, "toxic int, x array<int>, other array<int>").toArrow()
    dropped(rows)
    y = table["toxic"].to_numpy().astype(float)
    return _train(names, y, [np.array(v, int) for v in table["x"].to_pylist()], [None if v is None else np.array(v, int) for v in table["other"].to_pylist()], float(base), penalty, ridge)


def _train(names: list[str], y: np.ndarray, xs: list[np.ndarray], others: list, base: float, penalty: float, ridge: float, steps: int = 400) -> Model:
    """Full-batch gradient steps with per-weight scaling on the penalised logistic loss."""
    k, n = len(names), len(y)
    row, col = np.repeat(np.arange(n), [len(x) for x in xs]), np.concatenate([*xs, np.zeros(0, int)]).astype(int)
    swaps = [(x, o) for x, o in zip(xs, others) if o is not None]
    change = np.zeros((len(swaps), k))
    for i, (x, o) in enumerate(swaps):
        change[i, x] += 1
        change[i, o] -= 1
    w, bias = np.zeros(k), base
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[col], n))))
        err = (p - y) / n
        g = np.append(np.bincount(col, err[row], k) + ridge * w + 2 * penalty * change.T @ (change @ w) / n, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - d[:-1], bias - d[-1]
    return Model(names, w, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and score (double, 0 to 1; higher: likelier toxic), from the whole text alone.

    Null and empty texts get the bias's score. Rows are neither dropped nor joined; a column named
    score is replaced. No shuffle; the model is at most a few hundred words.
    """
    modest(docs.sparkSession)
    index = {w: i for i, w in enumerate(model.words)}
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(present(batch.column(names.index("text")), index)), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)
