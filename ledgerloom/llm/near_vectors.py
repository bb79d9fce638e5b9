"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one row kept.

Vectors of one label and length are compared exactly. Spherical k-means divides them into
cells, level by level: a label of more than ``FIRST`` vectors gets half as many centroids as the root of
their number, a cell of more than ``CELL`` vectors as many as make it small, ``FAN`` at most,
trained in a task of its own on at most about ``SAMPLE`` of its vectors, and every vector a home
among them, until cells are small or do not come apart.
A neighbour y of x with cos(x, y) >= c lies at most |x - y| = sqrt(2 - 2c) away, so x can
only have neighbours in the cell of q if it is that close to the bisecting plane of q and its
own centroid p: x.(p - q) / |p - q| <= sqrt(2 - 2c). x visits exactly those cells as a guest,
and their cells of the next level likewise, so each vector meets all its neighbours in its
own home cell, wherever they live.

A cell is compared in blocks: every block of ``BLOCK`` home vectors with every block of
``BLOCK`` vectors that live in or visit the cell. A block yields counts and, for each
vector, one link into its local component, never pairs. Equal vectors are one node with a
multiplicity and a number of its own, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import contained, discard, join_hot, stored

SAMPLE = 4_096
FIRST = 64
CELL = 2_048
FAN = 64
BLOCK = 2_048
ROWS = 16_384  # vectors placed by one task at once
MOST_LEVELS = 12


def usable(embedding: str) -> Column:
    """True for vectors that are not null or zero and have only finite components."""
    e = F.col(embedding)
    return F.coalesce(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def components_of(df: DataFrame, column: str) -> Column:
    """The vectors as doubles, or as floats where the input has floats."""
    kind = df.schema[column].dataType.simpleString()
    return F.col(column).cast(kind if kind == "array<float>" else "array<double>")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square is too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, turns: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd's steps on cosine."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def _train(key, data):
    """The centroids of one cell, one after another in one list."""
    x = unit(matrix(data.column("v")))
    c = k_means(x[np.lexsort(x.T[::-1])], int(data.column("k")[0].as_py()))
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "centroids": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})


def _place(reach: float):
    """The members of a part of a cell, each in its home and the cells that it visits."""

    def rows(key, members, model):
        x = unit(matrix(members.column("v")))
        c = np.array(model.column("centroids")[0].as_py()).reshape(-1, x.shape[1] if len(x) else 1)
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        at, to, home = [], [], []
        for begin in range(0, len(x), 4096):
            sim = x[begin : begin + 4096] @ c.T
            p = np.argmax(sim, axis=1)
            lead = sim[np.arange(len(sim)), p][:, None] - sim
            i, q = np.nonzero(lead <= (reach + 1e-9) * apart[p] + 1e-12)
            at.append(begin + i)
            to.append(q)
            home.append(q == p[i])
        at, to, home = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (at, to, home))
        got = members.take(pa.array(at, pa.int64()))
        lives = got.column("home").to_numpy(zero_copy_only=False).astype(bool) & home.astype(bool)
        return got.select(["id", "dim", "copies", "v", "cell"]).append_column("sub", pa.array(to.astype(np.int32))).append_column("home", pa.array(lives))

    return rows


def _cells(nodes: DataFrame, reach: float) -> DataFrame:
    """Rows (id, dim, copies, v, cell, home): every vector in all cells that it lives in or visits."""
    kinds = dict(nodes.dtypes)
    now = nodes.select("id", "dim", "copies", "v", F.xxhash64("label", "dim").alias("cell"), F.lit(True).alias("home"))
    done, before = None, None
    for level in range(MOST_LEVELS):
        sizes = now.groupBy("cell").agg(F.count_if("home").alias("n"), F.count("*").alias("all"), F.first("parent").alias("parent") if before is not None else F.lit(None).cast("long").alias("parent"))
        sizes = sizes.where(F.col("n") > (CELL if level else min(FIRST, CELL)))
        if before is not None:  # a cell that keeps nearly all of its parent does not come apart
            sizes = sizes.join(before, "parent").where("n < 0.9 * parent_n")
        sizes = stored(sizes.select("cell", "n", "all"), "sizes", 16)
        if not sizes.limit(1).count():
            break
        small = now.join(sizes.select("cell"), "cell", "left_anti").select("id", "dim", "copies", "v", "cell", "home")
        large = now.join(sizes, "cell").select("id", "dim", "copies", "v", "cell", "home", "n", "all")
        wanted = F.ceil(F.col("n") / CELL)
        wanted = wanted if level else F.greatest(wanted, F.ceil(F.sqrt("n") / 2))
        k = F.least(F.lit(FAN), F.greatest(F.lit(2), wanted)).cast("int")
        picked = large.where(F.col("home") & (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.lit(float(SAMPLE)) / F.col("n") * (1 << 30)))
        model = stored(picked.select("cell", "v", k.alias("k")).groupBy("cell").applyInArrow(_train, "cell long, centroids array<double>"), "centroids", 16)
        parts = F.ceil(F.col("all") / ROWS).cast("int")
        dealt = large.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int"))
        spread = model.join(sizes, "cell").select("cell", "centroids", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        placed = dealt.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(
            _place(reach), f"id long, dim int, copies long, v {kinds['v']}, cell long, sub int, home boolean")
        done = small if done is None else done.unionByName(small)
        now = stored(placed.select("id", "dim", "copies", "v", F.xxhash64("cell", "sub").alias("cell"), "home", F.col("cell").alias("parent")), "cells")
        before = sizes.select(F.col("cell").alias("parent"), F.col("n").alias("parent_n"))
    rest = now.select("id", "dim", "copies", "v", "cell", "home")
    return stored(rest if done is None else done.unionByName(rest), "placed")


def _products(threshold: float):
    def rows(key, data):
        role = data.column("role").to_numpy()
        ids, copies = data.column("id").to_numpy(), data.column("copies").to_numpy()
        x = unit(matrix(data.column("v")))
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        near = x[a] @ x[b].T >= threshold
        near &= ids[a][:, None] != ids[b][None]
        links = near @ copies[b]
        i, j = np.nonzero(near)
        # Local components over the ids of this block pair.
        names, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
        u, v = at[: len(a)][i], at[len(a) :][j]
        root = np.arange(len(names))
        while len(u):
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        linked = np.unique(np.concatenate([u, v])) if len(u) else np.empty(0, np.int64)
        linked = linked[root[linked] != linked]
        some = np.flatnonzero(links)
        n, m = len(some), len(linked)
        return pa.table({
            "id": pa.array(np.concatenate([ids[a][some], names[linked]])),
            "n": pa.array(np.concatenate([links[some], np.zeros(m)]).astype(np.int64)),
            "to": pa.array([None] * n + names[root[linked]].tolist(), pa.int64()),
        })

    return rows


def distinct_vectors(good: DataFrame) -> DataFrame:
    """(id, label, dim, least, copies, v): equal vectors of a label as one, numbered."""
    groups = good.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return groups.select(F.monotonically_increasing_id().alias("id"), "label", "dim", "least", "copies", "v")


@contained
def near_vectors(embeddings: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each input row.

    Null, zero or non-finite vectors, null labels and null ids link with nothing; a null id
    has a null component and is not kept. Rows that repeat an id count as vectors of their
    own. Labels are compared as texts. Vectors of different lengths are never linked. An empty table gives no rows.
    """
    raw = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), components_of(embeddings, vector_col).alias("v")).withColumn("dim", F.size("v"))
    takes_part = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = raw.where(takes_part)
    nodes = stored(distinct_vectors(good), "vectors")
    placed = _cells(nodes, math.sqrt(2 - 2 * threshold))
    sizes = placed.groupBy("cell", "dim").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nh"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nm")).where("nh > 0")
    at = placed.join(sizes, ["cell", "dim"])
    h, m = F.pmod(F.xxhash64("id"), F.col("nh")).cast("int"), F.pmod(F.xxhash64("id"), F.col("nm")).cast("int")
    homes = at.where("home").select("cell", "dim", h.alias("h"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), F.lit(0).alias("role"), "id", "copies", "v")
    others = at.select("cell", "dim", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("h"), m.alias("m"), F.lit(1).alias("role"), "id", "copies", "v")
    found = stored(homes.union(others).groupBy("cell", "dim", "h", "m").applyInArrow(_products(threshold), "id long, n long, to long"), "links", 4)
    discard(placed)
    label = components(found.where("to is not null").select(F.col("id").alias("u"), F.col("to").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    # A component is named by the smallest id of its rows; each row finds its node by its vector.
    info = nodes.join(counts, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "dim", "v", "least", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    info = stored(info, "info")
    names = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = info.join(names, "component").select("label", "dim", "v", "copies", "n_links", "component_id")
    linked = join_hot(good, info, ["label", "dim", "v"], "copies").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = raw.where(~takes_part).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.union(alone)
