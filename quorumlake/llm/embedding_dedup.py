"""Embedding near-duplicates: tiles of vectors in PCA order; leading dimensions first, suffix norms bound the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import NO_ID, connected_components, written

THRESHOLD = 0.93
#: Values of a tile's side (so many divided by the dimensions are its vectors), vectors that are compared at once, and
#: dimensions that are added at a time.
SIDE, BLOCK, STEP = 1 << 20, 1024, 16


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all 0, times a power of two each (which changes no digit), so that no square overflows
    or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """An array of lists of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _moments(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            for x in batch.column("embedding").slice(at, 2000).to_pylist():
                v = unit(np.asarray(x, np.float64))
                m = sums.setdefault(len(v), np.zeros((len(v) + 1, len(v) + 1)))
                w = np.append(v, 1.0)
                m += np.outer(w, w)
    for d, m in sums.items():
        i, j = np.indices(m.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], ["d", "i", "j", "x"])


def principal_axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of dimensions: the axes of all unit vectors' second moments, largest first, and the direction of the
    largest variance. The driver gets (d + 1) squared sums for each d."""
    sums = vectors.select("embedding").mapInArrow(_moments, "d long, i long, j long, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for d, part in sums.groupby("d"):
        m = np.zeros((d + 1, d + 1))
        m[part["i"], part["j"]] = part["x"]
        mean = m[d, :d] / m[d, d]
        second = m[:d, :d] / m[d, d]
        axes = np.linalg.eigh(second)[1][:, ::-1]
        out[int(d)] = axes, np.linalg.eigh(second - np.outer(mean, mean))[1][:, -1]
    return out


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows (in PCA order) whose cosine may reach ``threshold``: products of leading dimensions plus
    the product of suffix norms bound the cosine; the tile ends when no pair can reach it."""
    d = a.shape[1]
    left = np.sqrt(np.maximum(np.cumsum((a**2)[:, ::-1], axis=1)[:, ::-1], 0))
    right = np.sqrt(np.maximum(np.cumsum((b**2)[:, ::-1], axis=1)[:, ::-1], 0))
    i = j = None
    product = np.zeros((len(a), len(b)))
    for k in range(0, d, step):
        e = min(k + step, d)
        if i is None:
            product += a[:, k:e] @ b[:, k:e].T
            bound = product + np.outer(left[:, e], right[:, e]) if e < d else product
            if (may := bound >= threshold - 1e-9).mean() < 0.05 or e == d:
                i, j = np.nonzero(may)
                product = product[i, j]
        else:
            product = product + np.einsum("ij,ij->i", a[i, k:e], b[j, k:e])
            may = (product + (left[i, e] * right[j, e] if e < d else 0)) >= threshold - 1e-9
            i, j, product = i[may], j[may], product[may]
        if i is not None and not len(i):
            break
    return i, j


def _tile(threshold: float, axes) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        name, times = table.column("rep").to_numpy(), table.column("times").to_numpy()
        own = table.column("tile")[0].as_py()
        inside = own["c0"] == own["c1"] and own["b0"] == own["b1"]
        raw = scaled(matrix(table.column("embedding").combine_chunks()))
        norm = np.linalg.norm(raw, axis=1)
        turned = (raw / norm[:, None]) @ axes.value[raw.shape[1]][0]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if inside else 1))
        found = [(np.zeros(0, np.int64),) * 2]
        for p in range(0, len(left), BLOCK):
            for q in range(p if inside else 0, len(right), BLOCK):
                a, b = left[p : p + BLOCK], right[q : q + BLOCK]
                i, j = tile_links(turned[a], turned[b], threshold)
                i, j = a[i], b[j]
                if inside:
                    i, j = i[i < j], j[i < j]
                keep = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
                found.append((i[keep], j[keep]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        links = np.bincount(i, weights=times[j], minlength=len(name)) + np.bincount(j, weights=times[i], minlength=len(name))
        order = np.argsort(name)
        rank = np.empty(len(name), np.int64)
        rank[order] = np.arange(len(name))
        best = rank.copy()
        while len(i):  # smallest linked name, until it stays
            new = best.copy()
            np.minimum.at(new, i, best[j])
            np.minimum.at(new, j, best[i])
            new = np.minimum(new, new[order[new]])
            if (new == best).all():
                break
            best = new
        root = name[order[best]]
        some = np.flatnonzero(links > 0)
        return pa.table({"rep": pa.array(name[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and one length link at a cosine of ``threshold`` or more. A null vector, label or component,
    a component that isn't finite, or a zero vector: no links. Equal vectors of a label are compared once, as one with
    their number. Along the direction of the largest variance two linked vectors differ by sqrt(2 - 2 threshold) at
    most, so only cells of that width and their neighbours meet, in tiles of about SIDE values a side: a vector is
    copied once for each SIDE values of the cells near it. A tile tells each vector's number of links and its tile's
    smallest linked vector, never its pairs. A null vec_id is the smallest.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "embedding", "label")
    fine = F.expr("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    valid = rows.where(fine)
    reps = written(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")), "vectors")
    axes = spark.sparkContext.broadcast(principal_axes(reps))
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-6)) * (1 + 1e-9))

    def placed_in(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cells = []
                for x in part.column("embedding").to_pylist():
                    v = unit(np.asarray(x, np.float64))
                    cells.append(int(np.floor(v @ axes.value[len(v)][1] / width)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int64())], [*part.schema.names, "cell"])

    kind = reps.schema["embedding"].dataType.simpleString()
    turned = written(reps.mapInArrow(placed_in, f"label {reps.schema['label'].dataType.simpleString()}, embedding {kind}, rep long, times long, cell long").withColumn("d", F.size("embedding")), "placed")
    cells = turned.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) * F.col("d") / SIDE).cast("int").alias("blocks"))
    near = lambda shift, name: cells.select("label", "d", (F.col("cell") + shift).alias("cell"), F.col("blocks").alias(name))
    cells = cells.join(near(-1, "above"), ["label", "d", "cell"], "left").join(near(1, "below"), ["label", "d", "cell"], "left").na.fill(0, ["above", "below"])
    placed = turned.join(cells, ["label", "d", "cell"]).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = F.expr(
        """concat(
        transform(sequence(0, blocks - 1), o -> named_struct('tile', named_struct('c0', cell, 'b0', least(blk, o), 'c1', cell, 'b1', greatest(blk, o)), 'side', int(blk > o))),
        case when above > 0 then transform(sequence(0, greatest(above, 1) - 1), o -> named_struct('tile', named_struct('c0', cell, 'b0', blk, 'c1', cell + 1, 'b1', o), 'side', 0)) else array() end,
        case when below > 0 then transform(sequence(0, greatest(below, 1) - 1), o -> named_struct('tile', named_struct('c0', cell - 1, 'b0', o, 'c1', cell, 'b1', blk), 'side', 1)) else array() end)"""
    )
    spread = placed.withColumn("t", F.explode(tiles)).select("label", "d", "t.tile", "t.side", "rep", "times", "embedding")
    told = written(spread.groupBy("label", "d", "tile").applyInArrow(_tile(threshold, axes), "rep long, links long, root long"), "tiles")
    links = told.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(told.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "component")
    reps = reps.join(links, "rep", "left").join(classes, "rep", "left")
    reps = reps.select("label", "embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = valid.join(reps, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    kept = (F.col("vec_id") == F.col("component_id")).alias("kept")
    return out.select(F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "n_links", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"), kept)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row. Vectors that are null, empty, zero, or hold a null or
    non-finite component, and those without a label, link with nothing; finite ones of any magnitude are compared.
    Rows that are equal link; a cosine of exactly 0.93 in double precision links. A null vec_id is the smallest. An
    empty table gives an empty result. Other columns are not read."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as u, vec_id as w from embeddings union select r.u, p.w from reach r join pairs p on r.w = p.u),
c as (select u, min(w) as component_id from reach group by u),
n as (select u, count(*) as n_links from pairs group by u)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.u = e.vec_id left join n on n.u = e.vec_id
"""
