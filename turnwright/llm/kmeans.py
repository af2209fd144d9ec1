"""Centroid clustering in exact integers, with Hamerly's bounds.

A component x becomes the integer floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
`seed:<id>`, in the order of the hashes. A round assigns every vector to its nearest centroid (ties: the smaller number), then
replaces every centroid that has vectors by their componentwise floor(sum / count); one that has none stays.

Each vector carries two bounds through the rounds, in a file that outlives executors: an upper one of the distance to its own
centroid and a lower one of the distance to the second nearest. Where centroids have moved, the upper bound grows by its own
centroid's drift and the lower one shrinks by the largest drift of the others. A vector whose upper bound is below the lower one
keeps its centroid unseen; else its own distance is taken anew, and only if that does not settle it either are all k distances
scanned, in exact integers. Bounds are rounded outwards by SLACK, and equality never settles a vector, so assignments are those
of a full scan.

Scale: vectors are never shuffled. A round reads and writes them once, in Arrow batches; centroids' sums change only by vectors
that moved, so what is shuffled is k times the dimensions numbers of every task with moves. Sums are decimals of 38 digits.
The driver holds k centroids and their sums.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; nor do those
with a component of LIMIT or more after scaling, whose squared distances leave a long. Repeated rows are vectors of their own;
first centroids are picked among rows by hash, then by components, and rows without an id hash as `seed:`. With fewer than k
vectors there are fewer centroids. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

LIMIT, EXACT, SLACK = 1 << 27, 1 << 22, 1e-9
_STATE = "vec_id long, x array<int>, was int, cluster int, upper double, lower double, squared long"


def on_grid(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, x: the vectors that take part, as integers."""
    v = F.col(vec_col).cast("array<double>")
    whole = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= LIMIT))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and rows of c, exactly: in doubles where all integers on the way fit, else in longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most * most * 4 * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, squared distance to it and to the second nearest (of one centroid: the largest long)."""
    d = squared(x, c)
    best = d.argmin(1)
    own = d[np.arange(len(d)), best]
    d[np.arange(len(d)), best] = np.iinfo(np.int64).max
    return best, own, d.min(1)


def settled(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, x: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper, lower, and how many vectors were scanned, after centroids drifted to c."""
    far = np.argsort(-drift, kind="stable")
    others = np.where(cluster == far[0], drift[far[1]] if len(c) > 1 else 0.0, drift[far[0]])
    upper, lower, cluster = (upper + drift[cluster]) * (1 + SLACK), (lower - others) * (1 - SLACK), cluster.copy()
    open_ = np.flatnonzero(upper >= lower)
    upper[open_] = np.sqrt(((x[open_] - c[cluster[open_]]) ** 2).sum(1)) * (1 + SLACK)
    open_ = open_[upper[open_] >= lower[open_]]
    if len(open_):
        best, own, second = scanned(x[open_], c)
        cluster[open_], upper[open_], lower[open_] = best, np.sqrt(own) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK)
    return cluster, upper, lower, len(open_)


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64).reshape(rows, -1)


def first_round(grid: DataFrame, c: np.ndarray) -> DataFrame:
    """The state after a full scan; was is -1, so that every vector counts as moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, own, second = scanned(_matrix(batch.column(1), batch.num_rows), c)
            yield _state(batch.column(0), batch.column(1), np.full(len(best), -1), best, np.sqrt(own) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK), own)

    return grid.mapInArrow(run, _STATE)


def next_round(state: DataFrame, c: np.ndarray, drift: np.ndarray, last: bool) -> DataFrame:
    """The state after the centroids moved to c; exact squared distances in the last one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), batch.num_rows)
            was = batch.column(3).to_numpy()
            cluster, upper, lower, _ = settled(was, batch.column(4).to_numpy(), batch.column(5).to_numpy(), x, c, drift)
            own = ((x - c[cluster]) ** 2).sum(1) if last else np.zeros(len(x), np.int64)
            yield _state(batch.column(0), batch.column(1), was, cluster, upper, lower, own)

    return state.select("vec_id", "x", "was", "cluster", "upper", "lower").mapInArrow(run, _STATE)


def _state(ids: pa.Array, x: pa.Array, was: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(own)]
    return pa.RecordBatch.from_arrays([ids, x, *numbers], ["vec_id", "x", "was", "cluster", "upper", "lower", "squared"])


def moved_sums(state: DataFrame, dims: int) -> DataFrame:
    """cluster, n, sums: what vectors that moved add to each cluster and take from it."""
    ends = F.array(F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))
    moves = state.filter("cluster != was").select("x", F.explode(ends).alias("to")).filter("to.cluster >= 0").select("to.cluster", "to.sign", "x")

    def total(i: int) -> Column:
        return F.sum((F.get("x", i) * F.col("sign")).cast("decimal(18,0)"))

    return moves.groupBy("cluster").agg(F.sum("sign").alias("n"), F.array(*[total(i) for i in range(dims)]).alias("sums"))


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    grid = on_grid(vectors, dims, scale, id_col, vec_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = grid.withColumn("h", digest).orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r.x for r in first], np.int64)
    counts, sums = [0] * len(c), [[0] * dims for _ in c]
    state = cut(first_round(grid, c), "cluster-state")
    for done in range(rounds):
        for row in moved_sums(state, dims).collect():
            counts[row.cluster] += row.n
            sums[row.cluster] = [a + int(b) for a, b in zip(sums[row.cluster], row.sums, strict=True)]
        to = np.array([[s // n for s in total] if n else old for n, total, old in zip(counts, sums, c.tolist(), strict=True)], np.int64)
        drift = np.sqrt(((to - c) ** 2).sum(1)) * (1 + SLACK)
        before, c = state, to
        state = cut(next_round(before, c, drift, done == rounds - 1), "cluster-state")
        release(before)
    each = state.groupBy("cluster").agg(F.sum(F.col("squared").cast("decimal(20,0)")).alias("s")).collect()  # at most k rows
    inertia = sum(int(r.s) for r in each)
    names = [(r.cluster, int(r.s), inertia, hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()) for r in each]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", F.col("squared").alias("distance")).join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
