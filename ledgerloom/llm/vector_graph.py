"""Approximate nearest neighbours: a robust-pruned directed graph in every shard.

Vectors are dealt to shards of about ``SHARD``: to the nearest of k centroids (spherical
k-means on at most ``SAMPLE`` vectors), and within a centroid's cell by a hash where it is larger. In a shard, vectors are inserted in
batches: a greedy beam search from the entry point proposes neighbours; relaxed distance
pruning keeps the closest, drops candidates that are nearer (by the factor ``RELAX``) to a kept
neighbour, and repeats to ``DEGREE`` edges; kept edges are mirrored, and a node with more than
``SLACK`` edges over is pruned alike. Every vector gets in. Queries run a beam search of width
``BEAM`` on every shard of their ``PROBES`` nearest cells, so their work does not grow with
the number of shards, and the best of all, by cosine in double precision on the original vectors, win.

Equal vectors are one node of the graph with their smallest ids, as many as an answer can
use; others of the group can't be in any answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_vectors import components_of, k_means, matrix, unit, usable
from .work import contained, stored

SHARD = 16_384
SAMPLE = 20_000
MOST_CELLS = 1024
PROBES = 16
DEGREE = 32
SLACK = 16
BUILD_BEAM = 48
BEAM = 80
EXPAND = 4
RELAX = 1.2
BATCH = 512
QUERY_BLOCK = 512


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query row the ``beam`` nodes found nearest (-1: none), and their similarities.

    edges: a row for each node, -1 where there is none. All queries advance together, each
    expanding its EXPAND best nodes not yet expanded, until none is left in any beam.
    """
    m, beam = len(queries), max(beam, EXPAND)
    ids = np.full((m, beam), -1, np.int64)
    sim = np.full((m, beam), -np.inf, x.dtype)
    done = np.ones((m, beam), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = entry, queries @ x[entry], False
    seen = np.full((m, len(x)), -1, np.int32)
    seen[:, entry] = 0
    live = np.arange(m)
    while len(live):
        score = np.where(done[live], -np.inf, sim[live])
        top = np.argpartition(-score, EXPAND - 1, axis=1)[:, :EXPAND]
        open_ = np.isfinite(np.take_along_axis(score, top, axis=1))
        some = open_.any(axis=1)
        live, top, open_ = live[some], top[some], open_[some]
        if not len(live):
            break
        row = live[:, None]
        near = np.where(open_[:, :, None], edges[ids[row, top]], -1).reshape(len(live), -1)
        done[row, top] = True
        i, j = np.nonzero((near >= 0) & (seen[row, np.maximum(near, 0)] < 0))
        node, query = near[i, j], live[i]
        stamp = np.arange(len(i), dtype=np.int32)
        seen[query, node] = stamp
        once = seen[query, node] == stamp  # a node may come from several of those expanded
        i, j, node, query = i[once], j[once], node[once], query[once]
        value = np.full(near.shape, -np.inf, x.dtype)
        value[i, j] = np.einsum("ij,ij->i", x[node], queries[query])
        all_sim = np.concatenate([sim[live], value], axis=1)
        best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        sim[live] = np.take_along_axis(all_sim, best, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~np.isfinite(value)], axis=1), best, axis=1)
    ids[~np.isfinite(sim)] = -1
    return ids, sim


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each node at most DEGREE of its row of candidates (-1: none), diverse in direction,
    nearest first, then, where room is left, the nearest of the others; -1 for none."""
    rows = np.arange(len(nodes))
    candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    near = x[candidates]
    far = np.where(candidates >= 0, 2 - 2 * np.einsum("bcd,bd->bc", near, x[nodes]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    between = 2 - 2 * near @ near.transpose(0, 2, 1)
    open_ = np.isfinite(far)
    kept = np.zeros(far.shape, bool)
    for _ in range(DEGREE):
        k = np.argmax(open_, axis=1)
        some = open_[rows, k]
        if not some.any():
            break
        r, k = rows[some], k[some]
        kept[r, k] = True
        open_[r] &= RELAX**2 * between[r, k] > far[r]
        open_[r, k] = False
    first = np.argsort(~kept, axis=1, kind="stable")[:, :DEGREE]
    return np.take_along_axis(np.where(np.isfinite(far), candidates, -1), first, 1)


def _mirrored(x: np.ndarray, edges: np.ndarray, degree: np.ndarray, part: np.ndarray, own: np.ndarray) -> None:
    """Adds the edges from others to ``part``, pruning where a node has too many."""
    other, node = own.ravel(), np.repeat(part, own.shape[1])
    other, node = other[other >= 0], node[other >= 0]
    order = np.argsort(other, kind="stable")
    other, node = other[order], node[order]
    names, begin, count = np.unique(other, return_index=True, return_counts=True)
    nth = np.arange(len(other)) - np.repeat(begin, count)
    fits = degree[names] + count <= edges.shape[1]
    plain = np.repeat(fits, count)
    edges[other[plain], degree[other[plain]] + nth[plain]] = node[plain]
    degree[names[fits]] += count[fits]
    full, begin, count = names[~fits], begin[~fits], count[~fits]
    order = np.argsort(count, kind="stable")
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        new = np.full((len(some), int(count[some].max())), -1, np.int64)
        for k, s in enumerate(some.tolist()):
            new[k, : count[s]] = node[begin[s] : begin[s] + count[s]]
        got = prune(x, full[some], np.concatenate([edges[full[some]], new], axis=1))
        edges[full[some]] = -1
        edges[full[some], : got.shape[1]] = got
        degree[full[some]] = (got >= 0).sum(axis=1)


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges, entry) of the graph over unit rows, all of which get in."""
    n = len(x)
    edges = np.full((n, DEGREE + SLACK), -1, np.int64)
    degree = np.zeros(n, np.int64)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(17).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        part = order[at : at + min(BATCH, max(1, at))]
        found, _ = beam_search(x, edges, entry, x[part], BUILD_BEAM)
        # Rows of one batch do not see each other in the graph yet.
        within = x[part] @ x[part].T
        close = part[np.argsort(-within, axis=1, kind="stable")[:, : DEGREE // 2]]
        own = np.concatenate([prune(x, part[k : k + 256], np.concatenate([found, close], axis=1)[k : k + 256]) for k in range(0, len(part), 256)])
        edges[part, : own.shape[1]] = own
        degree[part] = (own >= 0).sum(axis=1)
        _mirrored(x, edges, degree, part, own)
        at += len(part)
    return edges, entry


def _search(k: int):
    def rows(key, index, queries):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not index.num_rows or not queries.num_rows:
            return empty
        index, queries = index.sort_by("first"), queries.sort_by("query_id")
        exact = unit(matrix(index.column("v")))
        x = exact.astype(np.float32)
        edges, entry = build(x)
        ids = index.column("ids").to_pylist()
        parts = []
        for at in range(0, queries.num_rows, QUERY_BLOCK):
            block = queries.slice(at, QUERY_BLOCK)
            q = unit(matrix(block.column("v")))
            found, _ = beam_search(x, edges, entry, q.astype(np.float32), BEAM)
            sim = np.where(found >= 0, np.einsum("bcd,bd->bc", exact[found], q), -np.inf)
            order = np.argsort(-sim, axis=1, kind="stable")
            for row, query in enumerate(block.column("query_id").to_pylist()):
                hits = []
                for c in order[row]:
                    node = found[row, c]
                    if node < 0 or len(hits) >= k and sim[row, c] < hits[k - 1][0] - 1e-12:
                        break
                    hits.extend((float(sim[row, c]), i) for i in ids[node] if i != query)
                    hits.sort(key=lambda h: (-h[0], h[1]))
                parts.extend((query, i, s) for s, i in hits[: k + 1])
        if not parts:
            return empty
        a, b, c = zip(*parts)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return rows


def _train(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for the vectors of each length that fill more than a shard."""
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().where(F.col("count") > SHARD).orderBy(F.desc("count"), "dim").limit(MOST_CELLS).collect()}
    total, out = sum(sizes.values()), {}
    for dim, n in sizes.items():
        k = min(math.ceil(n / SHARD), max(2, MOST_CELLS * n // total))
        share = SAMPLE / n
        rows = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("first", F.lit(29)), F.lit(1 << 30)) < share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()
        x = unit(matrix(rows.column("v")))
        if len(x):
            out[dim] = k_means(x[np.lexsort(x.T[::-1])], k)
    return out


def _nearest_cells(value, probes: int):
    """Each row once for each of its nearest cells, ``probes`` at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = value.value
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            vectors = batch.column(batch.schema.get_field_index("v"))
            at, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                c = model.get(int(dim))
                if c is None:
                    at.append(own)
                    cells.append(np.zeros(len(own), np.int64))
                    continue
                sim = unit(matrix(vectors.take(pa.array(own)))) @ c.T
                best = np.argsort(-sim, axis=1, kind="stable")[:, :probes]
                at.append(np.repeat(own, best.shape[1]))
                cells.append(best.ravel())
            got = batch.take(pa.array(np.concatenate(at)))
            yield pa.record_batch([*got.columns, pa.array(np.concatenate(cells).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return rows


@contained
def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of ``embeddings`` found for each
    row of ``queries`` (vec_id, embedding), never the row of the query's own id.

    Vectors that are null, zero or hold null or non-finite components, and null ids, take no
    part on either side; vectors of other lengths are not comparable. Ties go to the smaller
    id. A repeated id counts once for each different vector. Fewer than k rows give what
    there is; empty tables give none.
    """
    def good(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), components_of(df, "embedding").alias("v"))
        return rows.where(F.col("vec_id").isNotNull() & usable("v"))

    # The k + 1 smallest ids of equal vectors, first within salts, then over all.
    spark = embeddings.sparkSession
    few = good(embeddings).distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for key in (["v", "salt"], ["v"]):
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
        few = few.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    few = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(few.select("v", "ids", F.element_at("ids", 1).alias("first"), F.size("v").alias("dim")), "nodes")
    model = spark.sparkContext.broadcast(_train(nodes))
    kind = dict(nodes.dtypes)["v"]
    placed = nodes.mapInArrow(_nearest_cells(model, 1), f"v {kind}, ids array<long>, first long, dim int, cell int")
    # A row for each cell: MOST_CELLS at most, and one for each length of vectors without cells.
    sizes = stored(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "sizes", 16)
    index = placed.join(F.broadcast(sizes), ["dim", "cell"]).select("v", "ids", "first", "dim", "cell", F.pmod(F.xxhash64("first", F.lit(23)), F.col("shards")).cast("int").alias("shard"))
    asked = good(queries).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    asked = asked.mapInArrow(_nearest_cells(model, PROBES), f"query_id long, v {dict(asked.dtypes)['v']}, dim int, cell int").join(
        F.broadcast(sizes.select("dim", "cell", F.col("shards").alias("parts"))), ["dim", "cell"])
    asked = asked.select("query_id", "v", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"))
    key = ["dim", "cell", "shard"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
