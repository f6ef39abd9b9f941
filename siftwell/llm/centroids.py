"""Clustering of integer vectors around centroids, nearest ones found progressively on Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components of a vector, a power of two.
DIM = 64
#: Coefficients that are added up before centroids are eliminated again: coarse (few sign changes) to fine.
STEPS = (0, 4, 8, 16, 32, 64)
#: Up to this size of a component all sums of squares fit in 64 bits; larger ones are worked out with Python's integers.
PLAIN = 1 << 21


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, exact, by growing number of sign changes."""
    h = x
    n = h.shape[1]
    half = 1
    while half < n:
        h = h.reshape(len(x), n // (2 * half), 2, half)
        h = np.stack([h[:, :, 0] + h[:, :, 1], h[:, :, 0] - h[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return h[:, sequency(n)]


def sequency(n: int) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their row of the Hadamard matrix."""
    i = np.arange(n)
    signs = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smaller on ties) and the squared distance.

    The squared differences of the coefficients add up to n times the squared distance. After the first step the
    leading centroid is finished; a centroid whose sum so far is already larger than the leader's whole sum is strictly worse
    and goes on with no further step. Those that are left have finished all coefficients.
    """
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    h, c = transform(x), transform(centroids)
    n = h.shape[1]
    total = np.zeros((len(h), len(c)), h.dtype)
    alive = np.ones(total.shape, bool)
    bound = None
    for low, high in zip(STEPS[:-1], STEPS[1:], strict=True):
        row, col = np.nonzero(alive)
        d = h[row, low:high] - c[col, low:high]
        total[row, col] += (d * d).sum(1)
        if bound is None:
            d = h - c[total.argmin(1)]
            bound = (d * d).sum(1)
        alive &= total <= bound[:, None]
    best = np.where(alive, total, bound[:, None] + 1).argmin(1)
    return best, total[np.arange(len(h)), best] // n


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * component) of each vector, as integers of 64 bits or, if one is beyond PLAIN, of any size."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    flat = flat.astype(np.int64) if np.abs(flat).max(initial=0) <= PLAIN else np.array([int(v) for v in flat.tolist()], object)
    return flat.reshape(len(column), -1)


def _sums(kept: DataFrame, centroids: np.ndarray, scale: int) -> list:
    """(cluster, n, sums of the components) of the clusters that vectors fall in; a task hands on a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), [0] * len(centroids)
        for batch in batches:
            x = whole(batch.column("e"), scale)
            cluster, _ = nearest(x, centroids)
            for k in np.unique(cluster):
                n[k] += (cluster == k).sum()
                total[k] = total[k] + x[cluster == k].astype(object).sum(0) if x.dtype == object else total[k] + x[cluster == k].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), pa.array([[str(v) for v in total[k].tolist()] for k in some], pa.list_(pa.string()))], names=["cluster", "n", "total"])

    parts = kept.select("e").mapInArrow(run, "cluster long, n long, total array<string>")
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()  # a row for each centroid


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly 64 components, none null or non-finite, are kept; each component x becomes floor(scale * x). The first
    centroids are the k vectors with the least SHA-256 of `seed:id` (vectors without an id come last, those that share one
    in the order of their components). A round assigns all vectors, ties to the smaller number, and replaces each centroid that got
    any by the floored means of its vectors; then all are assigned once more. Fewer than k vectors give fewer
    centroids. Equal vectors fall in one cluster; repeated rows are vectors of their own. Centroids are k rows of 64 integers,
    the only thing that reaches the driver. Further columns are ignored; an empty table gives an empty result.
    Distances and sums that do not fit in 64 and 126 bits are an error.
    """
    sound = f"size(e) = {DIM} and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).where(F.expr(f"e is not null and coalesce({sound}, false)"))
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(digest), "e").limit(k).select("e").collect()
    if not first:
        return kept.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).limit(0)
    centroids = whole(pa.array([r["e"] for r in first], pa.list_(pa.float64())), scale)
    for _ in range(rounds):
        moved = centroids.astype(object)
        for r in _sums(kept, centroids, scale):
            moved[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIM)]
        centroids = moved.astype(np.int64) if max(abs(v) for v in moved.flat) <= PLAIN else moved

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(whole(batch.column("e"), scale), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=["id", "cluster", "distance"])

    placed = saved(kept.mapInArrow(place, "id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, v, sum(inertia.values()), sha[c]) for c, v in inertia.items()]
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
