"""Ball k-means over integer vectors, exact: clusters as balls, neighbours by radii, annuli of members."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.llm.common import in_arrow, written

#: Components beyond this count as this, so that squared distances fit 64 bits.
_MOST = 1 << 27
_STATE = "vec_id long, v array<int>, cluster int, distance long"


def quantised(vectors: DataFrame, scale: int, length: int) -> DataFrame:
    """(vec_id, v array<int>) with floor(scale * x), x as double, of the vectors of exactly `length` finite components.

    Others take no part. Results beyond 2^27 in size count as 2^27, whose squared distances
    still fit a long at 64 components. Null and repeated vec_ids are vectors of their own.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(x.isNotNull() & (F.size(x) == length)).filter(F.coalesce(finite, F.lit(False)))
    cut = lambda c: F.greatest(F.lit(-float(_MOST)), F.least(F.lit(float(_MOST)), c.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(cut(c)).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors of smallest lowercase hex sha256 of `1:<vec_id>`, in that order; equal ids by their components.

    Fewer rows give fewer. A null vec_id is hashed as nothing after the colon.
    """
    rank = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(rank, "v").limit(k).select("v").collect()  # k vectors
    return np.array([r["v"] for r in found], np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centroids) squared distances of integers, exact: by floating point where that is exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _all_nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = _squared(x, centroids)
    best = apart.argmin(1)
    return best, apart[np.arange(len(x)), best]


def neighbours(centroids: np.ndarray, radii: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball its neighbour centroids by distance, and their squared distances.

    Some member can be as near to centroid j as to its own i only if the centroids are at most
    twice i's radius apart; radii may be too great but not too small. Distances are integers,
    so the comparison leaves room for the rounding of a radius only.
    """
    apart = _squared(centroids, centroids)
    out = []
    for i, r in enumerate(radii):
        near = np.flatnonzero(apart[i] <= 4 * r * r * (1 + 1e-9) + 1)
        near = near[near != i]
        near = near[np.lexsort((near, apart[i][near]))]
        out.append((near, apart[i][near]))
    return out


def reassigned(x: np.ndarray, old: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of vectors whose last clusters are known, as by comparing with all centroids.

    A member nearer to its centroid than half the way to the nearest neighbour is in the stable
    core and stays. Half the way to each further neighbour bounds an annulus, and a member is
    compared with just the neighbours whose half way it has reached: by the triangle inequality
    the others are farther from it than its own centroid. Ties go to the smaller number, so a
    member exactly half way is compared too.
    """
    cluster, distance = old.copy(), np.empty(len(x), np.int64)
    for i in np.unique(old):
        mine = np.flatnonzero(old == i)
        own = _squared(x[mine], centroids[i : i + 1])[:, 0]
        others, apart = near[i]
        best, at = own.copy(), np.full(len(mine), i)
        annulus = np.searchsorted(apart / 4, own, side="right")  # so many neighbours at half a way or less
        for place, j in enumerate(others[: annulus.max(initial=0)]):
            reach = np.flatnonzero(annulus > place)
            d = _squared(x[mine[reach]], centroids[j : j + 1])[:, 0]
            better = (d < best[reach]) | ((d == best[reach]) & (j < at[reach]))
            best[reach[better]], at[reach[better]] = d[better], j
        cluster[mine], distance[mine] = at, best
    return cluster, distance


def _assign(rows: DataFrame, centroids: np.ndarray, near=None) -> DataFrame:
    """rows with (cluster, distance): by all centroids at first, then by the balls of the last clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["v"].flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
                cluster, distance = _all_nearest(x, centroids) if near is None else reassigned(x, batch["cluster"].to_numpy(), centroids, near)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return written(in_arrow(rows, run, _STATE))


def _sums(state: DataFrame, length: int) -> list:
    """One row a cluster: members, sums of components, greatest and summed squared distance."""
    sums = [F.sum(F.element_at("v", d + 1).cast("long")).alias(f"s{d}") for d in range(length)]
    return state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r"), *sums).collect()


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, length: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector that takes part.

    Exact k-means over quantised() vectors: `rounds` times every vector goes to the nearest
    centroid by squared Euclidean distance, ties to the smaller number, and each centroid with
    members becomes their componentwise floor(sum / count); an empty one stays. Then vectors
    are assigned once more. first_centroids() are the start. Rows that repeat are members each.
    An empty table, or one without usable vectors, gives no rows.

    The driver holds k centroids and radii, and compares centroids with each other, so k is
    meant to be thousands at most. Each round reads the vectors once, writes them with their
    clusters to the shared folder, as small integers, and adds up k rows of sums; no vector is
    shuffled. A ball's radius about its moved centroid is at most the old one plus the move.
    """
    rows = quantised(vectors, scale, length)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).filter("false")
    state = _assign(rows, centroids)
    for _ in range(rounds):
        moved, radii = centroids.copy(), np.zeros(len(centroids))
        for row in _sums(state, length):
            moved[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(length)]
            radii[row["cluster"]] = row["r"] ** 0.5
        radii += np.sqrt(((moved - centroids) ** 2).sum(1))
        centroids = moved
        state = _assign(state, centroids, neighbours(centroids, radii))
    inertia = [0] * len(centroids)
    for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect():
        inertia[row["cluster"]] = int(row["s"])
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    bound = lambda n: min(n, (1 << 63) - 1)
    return state.select("vec_id", "cluster", "distance", of([bound(n) for n in inertia]).cast("long").alias("cluster_inertia"), F.lit(bound(sum(inertia))).cast("long").alias("inertia"), of(hashes).alias("centroid_sha256"))
