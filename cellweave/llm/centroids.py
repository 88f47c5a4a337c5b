"""Centroid clustering with Hamerly's bounds: a vector whose upper bound is below its lower one keeps its centroid unseen."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_arrow, materialize, unused
from .vectors import matrix, met, partial_sums, quoted, squared, whole_vectors

#: Bounds are doubles, widened by more than their rounding.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equally near ones), bound from above on its distance, bound from below on the second nearest's: from all exact distances."""
    d = np.stack([squared(v, c) for c in centroids], 1)
    near, rows = d.argmin(1), np.arange(len(v))
    upper = _root(d[rows, near]) * UP
    if len(centroids) == 1:
        return near, upper, np.full(len(v), np.inf)
    rest = d.astype(object) if d.dtype == object else d.copy()
    rest[rows, near] = np.iinfo(np.int64).max if d.dtype != object else 2**200
    return near, upper, _root(rest.min(1)) * DOWN


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after the centroids' drift: the own one's is added, the largest of the others' taken off."""
    order = np.argsort(-drift, kind="stable")
    others = np.where(cluster == order[0], drift[order[1]] if len(order) > 1 else 0.0, drift[order[0]])
    return (upper + drift[cluster]) * UP, np.maximum(0.0, (lower - others) * DOWN)


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A round of Hamerly's test: loosen bounds; where they meet, tighten the upper one; where they still meet, scan all centroids exactly."""
    upper, lower = moved_bounds(cluster, upper, lower, drift)
    cluster = cluster.copy()
    close = np.flatnonzero(upper >= lower)
    upper[close] = _root(squared(v[close], centroids[cluster[close]])) * UP
    close = close[upper[close] >= lower[close]]
    if len(close):
        cluster[close], upper[close], lower[close] = scan(v[close], centroids)
    return cluster, upper, lower


def cluster_vectors(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3
) -> tuple[DataFrame, np.ndarray]:
    """(df without its vectors, with cluster and distance, squared; the final centroids).

    Vectors with exactly dims components, none null or non-finite, are kept. Centroids start as the kept vectors with the least
    SHA-256 of `seed:key` (equal keys by their vectors); each of the rounds assigns every vector to the nearest, the smaller
    number of equally near ones, and replaces each centroid that has vectors by their mean, rounded down. Rows with a
    null key are clustered, but never start a centroid; repeated rows count as often as they occur. Fewer keyed vectors than k make
    fewer centroids, none no rows. Columns of df named cluster or distance are replaced.

    A round is one pass that writes each vector's cluster and two bounds, and sums only vectors that changed
    their cluster; it ends early when none does, for then nothing changes any more. k * dims sums reach the driver.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != vector and c.lower() not in ("cluster", "distance")]
    own, was, upper, lower = unused(df, "v", "was", "upper", "lower")
    kept = whole_vectors(df.select(*quoted(*columns, vector)), vector, scale, own).where(F.size(own) == dims)
    (name,) = quoted(key)
    state = materialize(kept)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), name.cast("string")), 256)
    centroids = np.array([r[0] for r in state.where(name.isNotNull()).orderBy(order, own).limit(k).select(own).collect()], np.int64)
    results = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    carried = T.StructType([state.schema[c] for c in [*columns, own]])
    if not len(centroids):
        return spark.createDataFrame([], T.StructType([state.schema[c] for c in columns] + results)), centroids
    full = T.StructType([*carried, T.StructField("cluster", T.IntegerType()), T.StructField(was, T.IntegerType()), T.StructField(upper, T.DoubleType()), T.StructField(lower, T.DoubleType())])
    n, sums, drift = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), None

    def round_of(centroids, drift):
        def run(batches):
            for batch in batches:
                v = matrix(batch.column(own), dims)
                if drift is None:
                    (now, up, low), before = scan(v, centroids), pa.nulls(len(v), pa.int32())
                else:
                    before = batch.column("cluster")
                    now, up, low = reassign(v, before.to_numpy(), batch.column(upper).to_numpy().copy(), batch.column(lower).to_numpy().copy(), centroids, drift)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried.names), pa.array(now, pa.int32()), before, pa.array(up), pa.array(low)], full.names)

        return run

    def changes(batch):
        v, before = matrix(batch.column(own), dims), batch.column(was).fill_null(-1).to_numpy()
        yield batch.column("cluster").to_numpy(), v, 1
        yield before[before >= 0], v[before >= 0], -1

    for k_round in range(rounds + 1):
        new = materialize(map_arrow(state, round_of(centroids, drift), full))
        discard(state)
        state = new
        if k_round == rounds:
            break
        more = met(state.where(f"`{was}` is null or cluster <> `{was}`").select(own, was, "cluster").mapInArrow(partial_sums(len(centroids), dims, changes), "group int, n long, totals array<long>"), len(centroids), dims)
        n, sums = n + more[0], sums + more[1]
        fresh = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        drift = np.atleast_1d(_root(squared(fresh, centroids))) * UP
        centroids = fresh
        if not drift.any():
            break

    def distances(batches):
        for batch in batches:
            cluster = batch.column("cluster")
            d = squared(matrix(batch.column(own), dims), centroids[cluster.to_numpy()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), cluster, pa.array(d.tolist(), pa.int64())], [*columns, "cluster", "distance"])

    return map_arrow(state.select(*quoted(*columns), own, "cluster"), distances, T.StructType([state.schema[c] for c in columns] + results)), centroids


def digest_clusters(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. One row for each centroid meets the rows."""
    rows = materialize(clustered.select("vec_id", "cluster", "distance"))
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # as many as centroids
    table = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    known = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
