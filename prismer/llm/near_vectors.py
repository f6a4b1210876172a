"""Embedding near-duplicates by tiles of PCA-ordered vectors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismer.llm.common import components, saved

TILE = 1024
#: Dimensions, the most frequent, whose vectors are turned to their principal axes; others are compared as they are.
AXES = 32
#: Cosines of turned vectors, kept in single precision, are off by less than this.
SLACK = 1e-6
#: Bytes of the turned vectors of a group of tiles, of which two meet in a task.
GROUP = 8 << 20


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors of dim components, these as unit vectors, and as given."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy() == dim)
    m = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    most = np.abs(m).max(1, initial=0)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(m / np.maximum(most[:, None], 1e-300), axis=1) * most
    ok = np.isfinite(m).all(1) & (norm > 0) & np.isfinite(norm)
    return rows[ok], m[ok] / norm[ok][:, None], m[ok]


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Axes of greatest second moment of all unit vectors, leading first: sums of dim x dim numbers, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            _, u, _ = _units(batch.column(0), dim)
            total += u.T @ u
        i = np.arange(dim * dim, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel())], ["i", "x"])

    total = np.zeros(dim * dim)
    for i, x in rows.select("embedding").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x")).collect():
        total[i] = x
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float, lead: int = 16, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (or i < j within a) whose cosine reaches the threshold.

    Vectors are unit and in PCA order. Products of the leading dimensions are accumulated in steps;
    what the rest can add is at most the product of the two suffix norms, and a tile's rows and
    columns that cannot reach the threshold any more are left out of the next step.
    """
    slack = SLACK
    other = a if b is None else b
    rows, cols = np.arange(len(a)), np.arange(len(other))
    dots = np.zeros((len(a), len(other)))
    rest_a = np.sqrt(np.maximum(0, np.cumsum((a * a)[:, ::-1], 1)[:, ::-1]))
    rest_b = rest_a if b is None else np.sqrt(np.maximum(0, np.cumsum((other * other)[:, ::-1], 1)[:, ::-1]))
    dim, at = a.shape[1], 0
    while at < dim:
        to = min(dim, at + (lead if at == 0 else step))
        dots += a[rows, at:to] @ other[cols, at:to].T
        at = to
        if at < dim:
            can = dots + np.outer(rest_a[rows, at], rest_b[cols, at]) >= threshold - slack
            keep_r, keep_c = can.any(1), can.any(0)
            if not keep_r.any():
                return np.zeros(0, int), np.zeros(0, int)
            if keep_r.mean() * keep_c.mean() < 0.7:
                rows, cols, dots = rows[keep_r], cols[keep_c], dots[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(dots >= threshold - slack)
    i, j = rows[i], cols[j]
    if b is None:
        i, j = i[i < j], j[i < j]
    return i, j


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows of equal non-null label link when their cosine, in double precision, is at least the
    threshold. Null, zero, wrongly sized or non-finite vectors link with nothing (0 links, own
    component, kept). vec_id is taken as a key: repeated rows count once and share a result; where
    one vec_id stands for several vectors their links are added, also for rows equal to one of
    them; rows with a null vec_id link with nothing. Extra columns are ignored.

    Equal vectors of a label are compared once, with their number as weight. The vectors of a label
    are ordered by their leading principal component and cut into groups of about `group` bytes and
    those into tiles of `tile` rows. Two groups, and in them two tiles, meet only if their ranges of
    the leading three components come as near as the threshold needs; a meeting of two groups is one
    unit of work, however large the label, so a vector travels once for each group it meets.
    Vectors of dimensions beyond the AXES most frequent are not turned, which only costs pruning.
    Tasks return each row's number of links and the links of a spanning forest, never all pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    usable = rows.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").withColumn("dim", F.size("embedding"))
    dims = [r[0] for r in usable.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(AXES + 1).collect()]
    turned_dims, others = sorted(dims[:AXES]), len(dims) > AXES
    kind = "vec_id long, label string, dim int, c0 double, c1 double, c2 double, same binary, v binary"
    turned = None
    for dim in [*turned_dims, *[None] * others]:
        some = usable.where(~F.col("dim").isin(turned_dims) if dim is None else F.col("dim") == dim)
        axes = None if dim is None else principal_axes(some, dim)

        def turn(batches: Iterator[pa.RecordBatch], axes=axes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim in pc.unique(batch.column(3)).to_pylist():
                    part = batch.filter(pc.equal(batch.column(3), dim))
                    i, u, given = _units(part.column(1), dim)
                    t = u if axes is None else u @ axes
                    c = np.pad(t[:, :3], ((0, 0), (0, max(0, 3 - dim))))
                    same = pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in given], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(i)), part.column(2).take(pa.array(i)), pa.array(np.full(len(i), dim, np.int32)), *[pa.array(c[:, k]) for k in range(3)], same, pa.array([x.tobytes() for x in t.astype(np.float32)], pa.binary())],
                        [x.split()[0] for x in kind.split(", ")],
                    )

        part = some.select("vec_id", "embedding", "label", "dim").mapInArrow(turn, kind)
        turned = part if turned is None else turned.unionByName(part)
    own = rows.select("vec_id")
    if turned is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = saved(turned.withColumn("cell", F.floor(F.col("c0") * 4096).cast("int")))
    # equal vectors: ids and digests alone are shuffled
    same = ["label", "dim", "same"]
    repeated = cells.groupBy(same).agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last")).where("rep != last").drop("last")
    members = saved(cells.select("vec_id", *same).join(repeated, same).distinct())
    members = members.join(members.groupBy(same).agg(F.count("*").alias("w")), same)
    alone = cells.join(members, ["vec_id", *same], "left").where("rep is null or rep = vec_id").withColumn("w", F.coalesce("w", F.lit(1)))
    # groups by the leading component: cells of it follow each other, rows of a cell are spread by a hash
    sizes = alone.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = saved(sizes.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))))
    spot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    most = F.greatest(F.lit(tile), F.floor(F.lit(group) / (4 * F.col("dim"))))
    grouped = alone.join(shifts, ["label", "dim", "cell"]).withColumn("grp", F.floor((F.col("shift") + spot * F.col("n")) / most).cast("int"))
    boxes = saved(grouped.groupBy("label", "dim", "grp").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("c0", "c1", "c2") for f in (F.min, F.max)]))
    left, right = boxes, boxes.select("label", "dim", *[F.col(c).alias(f"o_{c}") for c in boxes.columns if c not in ("label", "dim")])
    gap = lambda c: F.greatest(F.col(f"min_{c}") - F.col(f"o_max_{c}"), F.col(f"o_min_{c}") - F.col(f"max_{c}"), F.lit(0.0))
    far = 2 * (1 - threshold) + SLACK
    near = sum((gap(c) * gap(c) for c in ("c1", "c2")), gap("c0") * gap("c0")) <= far
    meet = left.join(right, ["label", "dim"]).where((F.col("grp") <= F.col("o_grp")) & near)
    meet = meet.select("label", "dim", F.col("grp").alias("ga"), F.col("o_grp").alias("gb"))
    sides = meet.select("label", "dim", "ga", "gb", F.explode(F.when(F.col("ga") == F.col("gb"), F.array("ga")).otherwise(F.array("ga", "gb"))).alias("grp"))
    work = grouped.select("label", "dim", "grp", "vec_id", "w", "c0", "v").join(sides, ["label", "dim", "grp"]).select("label", "dim", "ga", "gb", "grp", "vec_id", "w", "c0", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, ga, gb = (int(pdf[c].iat[0]) for c in ("dim", "ga", "gb"))
        pdf = pdf.drop_duplicates(["grp", "vec_id", "v"]).sort_values(["c0", "vec_id"])
        ids, w, first = pdf["vec_id"].to_numpy(), pdf["w"].to_numpy(), pdf["grp"].to_numpy() == ga
        m = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(-1, dim)
        cut = lambda rows: [(rows[i : i + tile], m[rows[i : i + tile], :3]) for i in range(0, len(rows), tile)]
        left = [(r, c.min(0), c.max(0)) for r, c in cut(np.flatnonzero(first))]
        right = left if ga == gb else [(r, c.min(0), c.max(0)) for r, c in cut(np.flatnonzero(~first))]
        n, spans, close = np.zeros(len(ids)), [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for p, (ra, low, high) in enumerate(left):
            a = m[ra].astype(np.float64)
            for q, (rb, low_b, high_b) in enumerate(right):
                apart = np.maximum(0, np.maximum(low - high_b, low_b - high)).astype(np.float64)
                if (ga == gb and q < p) or apart @ apart > far:
                    continue
                inner = ga == gb and p == q
                b = a if inner else m[rb].astype(np.float64)
                i, j = tile_links(a, None if inner else b, threshold)
                unsure = np.abs(np.einsum("ij,ij->i", a[i], b[j]) - threshold) <= SLACK
                x, y = ra[i], rb[j]
                use = ids[x] != ids[y]
                close.append(np.stack([x[unsure & use], y[unsure & use]], 1))
                x, y = x[~unsure & use], y[~unsure & use]
                n += np.bincount(x, w[y], len(ids)) + np.bincount(y, w[x], len(ids))
                spans.append(_forest(x, y))
        span, close = np.concatenate(spans), np.concatenate(close)
        span, linked = _forest(span[:, 0], span[:, 1]), np.flatnonzero(n)
        return pd.concat(
            [
                pd.DataFrame({"a": ids[linked], "b": 0, "n": n[linked].astype(np.int64), "m": 0, "kind": 0}),
                pd.DataFrame({"a": ids[span[:, 0]], "b": ids[span[:, 1]], "n": 0, "m": 0, "kind": 1}),
                pd.DataFrame({"a": ids[close[:, 0]], "b": ids[close[:, 1]], "n": w[close[:, 1]], "m": w[close[:, 0]], "kind": 2}),
            ]
        )

    found = saved(work.groupBy("label", "dim", "ga", "gb").applyInPandas(compare, "a long, b long, n long, m long, kind int"))
    # pairs at the threshold itself are decided on the vectors as given, not as turned
    pairs = found.where("kind = 2").drop("kind")
    given = usable.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    two = pairs.join(given.select(F.col("vec_id").alias("a"), F.col("e").alias("ea")), "a").join(given.select(F.col("vec_id").alias("b"), F.col("e").alias("eb")), "b")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    ea, eb = F.col("ea"), F.col("eb")
    sure = saved(two.where(dot(ea, eb) / (F.sqrt(dot(ea, ea)) * F.sqrt(dot(eb, eb))) >= threshold).select("a", "b", "n", "m").distinct())
    counted = found.where("kind = 0").select(F.col("a").alias("vec_id"), "n").unionByName(sure.select(F.col("a").alias("vec_id"), "n")).unionByName(sure.select(F.col("b").alias("vec_id"), F.col("m").alias("n")))
    counts = saved(counted.groupBy("vec_id").agg(F.sum("n").alias("n")))
    copies = members.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    total = counts.join(members.select("vec_id"), "vec_id", "left_anti").unionByName(copies).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    edges = found.where("kind = 1").select("a", "b").unionByName(sure.select("a", "b")).unionByName(members.where("vec_id != rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    roots = components(edges)
    out = own.join(total, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each linked row a link to the least row of its component among these links."""
    names, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = back[: len(x)], back[len(x) :]
    root = np.arange(len(names))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    keep = root != np.arange(len(names))
    return np.stack([names[keep], names[root[keep]]], 1)
